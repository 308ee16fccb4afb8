"""Templates of the licence scan: notices, standard headers and whole texts by SPDX identifier."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

WARRANTY = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
MIT_TEXT = f"MIT License Copyright (c) {MIT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. {WARRANTY}"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_TWO = f"{BSD}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_FOURTH = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC = "and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
APACHE = "you may not use this file except in compliance with the License."
APACHE_END = "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
REMOTE = "Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."
#: Family, its name, its versions as written and as in identifiers, and the day of each version.
GNU = [
    ("GPL", "General", [("1", "1.0", "February 1989"), ("2", "2.0", "June 1991"), ("3", "3.0", "29 June 2007")]),
    ("LGPL", "Library General", [("2", "2.0", "June 1991")]),
    ("LGPL", "Lesser General", [("2.1", "2.1", "February 1999"), ("3", "3.0", "29 June 2007")]),
    ("AGPL", "Affero General", [("3", "3.0", "19 November 2007")]),
]
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
REGION = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def whole(name: str) -> str:
    return (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")


@lru_cache(maxsize=1)
def templates() -> dict[str, list[str]]:
    """Identifiers and the texts that stand for them."""
    out = {
        "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", f"{MIT}.", MIT_TEXT],
        "Apache-1.1": ["The Apache Software License, Version 1.1", "Licensed under the Apache License, Version 1.1."],
        "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", f"Licensed under the Apache License, Version 2.0 (the \"License\"); {APACHE}", f"Licensed under the Apache License, Version 2.0 (the \"License\"); {APACHE} {APACHE_END}", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", whole("Apache-2.0")],
        "BSD-2-Clause": ["Released under the BSD 2-Clause License.", f"BSD 2-Clause License Copyright (c) All rights reserved. {BSD_TWO} {BSD_END}"],
        "BSD-3-Clause": ["Released under the BSD 3-Clause License.", f"{BSD}.", f"BSD 3-Clause License Copyright (c) All rights reserved. {BSD_TWO} {BSD_THIRD} {BSD_END}"],
        "BSD-4-Clause": ["Released under the BSD 4-Clause License.", f"BSD 4-Clause License Copyright (c) All rights reserved. {BSD_TWO} {BSD_FOURTH} {BSD_END}"],
        "ISC": ["Released under the ISC License.", f"Permission to use, copy, modify, {ISC}, provided that the above copyright notice and this permission notice appear in all copies.", f"ISC License Copyright (c) Permission to use, copy, modify, {ISC}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_END}"],
        "0BSD": ["Released under the Zero-Clause BSD License (0BSD).", f"Zero-Clause BSD Permission to use, copy, modify, {ISC}. {ISC_END}"],
        "Zlib": ["Released under the zlib License.", f"zlib License Copyright (c) {ZLIB}"],
        "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", f"Boost Software License - Version 1.0 - August 17th, 2003 {BOOST} {WARRANTY}"],
        "Unlicense": ["Released into the public domain under the Unlicense.", whole("Unlicense")],
        "Artistic-1.0": ["Licensed under the Artistic License.", whole("Artistic-1.0")],
        "MPL-1.1": ["Licensed under the Mozilla Public License, version 1.1.", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/", whole("MPL-1.1")],
        "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", whole("MPL-2.0")],
        "CC0-1.0": ["Released into the public domain under CC0 1.0.", whole("CC0-1.0")],
    }
    for version in ("1.0", "2.0"):
        out[f"EPL-{version}"] = [f"Licensed under the Eclipse Public License, version {version}.", f"All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v{version} which accompanies this distribution", f"Eclipse Public License - v {version}"]
    for family, kind, versions in GNU:
        full = f"GNU {kind} Public License"
        what = "library" if family == "LGPL" else "program"
        for said, version, day in versions:
            free = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation, either version {said} of the License, or (at your option) any later version."
            rest = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {full} for more details. You should have received a copy of the {full} along with this {what}."
            name = f"{family}-{version}"
            out[name] = [f"This work is licensed under the {full}, version {said}.", f"Licensed under the {full}, version {said}.", f"Licensed under the {family} {version}.", f"Licensed under the {family}v{said}.", f"{full} Version {said}, {day}", free, f"{free} {rest}", free.replace("either version", "version").replace(", or (at your option) any later version", "")]
            out[name] += [f"SPDX-License-Identifier: {name}-{x}" for x in ("only", "or-later")]
            if family != "AGPL":
                out[name].append(whole(name))
    # the whole text is that of GPL-3.0 but for the name and section 13
    out["AGPL-3.0"].append(whole("GPL-3.0").replace("GENERAL PUBLIC", "AFFERO GENERAL PUBLIC").replace("GNU General Public", "GNU Affero General Public").replace("29 June 2007", "19 November 2007") + REMOTE)
    for kind, name in CREATIVE.items():
        for version, region in REGION.items():
            out[f"CC-{kind}-{version}"] = [f"Licensed under CC {kind} {version}.", f"This work is licensed under a Creative Commons {name} {version} {region} License."]
        # the whole texts share all but the clauses that their names name
        said = whole("CC-BY-SA-4.0").replace("Attribution-ShareAlike", name)
        out[f"CC-{kind}-4.0"].append(said if "SA" in kind else said.replace("ShareAlike", "").replace("BY-SA", kind))
    for name, texts in out.items():
        texts.append(f"SPDX-License-Identifier: {name}")
    return out
