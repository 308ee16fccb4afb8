"""Spreadsheet files (Office Open XML) made by the tasks that hold the rows, with the standard library only.

A workbook has one sheet: bold labels in a frozen first row, a table with a filter over
all rows, widths by content, days and times as typed cells, ids as text. Equal rows give
equal bytes.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from datetime import date, datetime, timezone
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import guarded_text

#: Labels of exported columns by what is exported.
SIMPLE = {"internal_id": "ID interno", "event_id": "ID na fonte", "name": "Nome", "event_date": "Data", "city": "Cidade", "state": "UF", "source": "Fonte", "url": "URL de origem", "publication": "Publicação"}
FULL = SIMPLE | {"description": "Descrição", "location": "Local", "address": "Endereço", "modality": "Modalidade", "registration": "Inscrição", "official": "Site oficial", "image": "Imagem", "references": "Referências de fontes", "updated_at": "Atualizado em", "metadata_json": "Metadados completos (JSON)"}
RESULTS = {
    "event_id": "event_id", "event": "Evento", "event_date": "Data do evento", "city": "Cidade", "state": "UF", "modality": "Modalidade", "distance_km": "Distância em km", "gender": "Gênero", "overall_position": "Posição geral", "category_position": "Posição na categoria",
    "category": "Categoria", "bib": "Número", "name": "Nome", "team": "Equipe", "pace": "Pace", "time": "Tempo", "gap": "Gap", "source_url": "URL de origem", "extracted_at": "Data e hora da extração",
}
#: Rows and bytes of text of a part, and bytes of an export.
PART_ROWS, PART_BYTES, TOTAL_BYTES = 25_000, 16 << 20, 50 << 20
#: Columns that are text whatever they look like.
AS_TEXT = ("bib", "event_id")

_SPACE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Cell styles by number: plain, label, text, day, time.
_STYLES = f'{_HEAD}<styleSheet xmlns="{_SPACE}"><numFmts count="2"><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="dd/mm/yyyy hh:mm:ss"/></numFmts><fonts count="2"><font/><font><b/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="5"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="49" applyNumberFormat="1"/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="165" applyNumberFormat="1"/></cellXfs></styleSheet>'
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def column_name(k: int) -> str:
    """A, B, ..., Z, AA, ... of a column from 0."""
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, value, style: int) -> str:
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return ""
    if isinstance(value, datetime):
        at = value if value.tzinfo is None else value.astimezone(timezone.utc).replace(tzinfo=None)
        return f'<c r="{ref}" s="4"><v>{(at - datetime(1899, 12, 30)).total_seconds() / 86400!r}</v></c>'
    if isinstance(value, date):
        return f'<c r="{ref}" s="3"><v>{(value - date(1899, 12, 30)).days}</v></c>'
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(_FORBIDDEN.sub("", guarded_text(str(value))))}</t></is></c>'


def workbook(rows: Iterable[tuple], columns: dict[str, str], sheet: str = "Dados") -> bytes:
    """The file's bytes; without rows the sheet has one empty one."""
    labels, names = list(columns.values()), list(columns)
    widths = [len(x) for x in labels]
    lines = ["".join(_cell(f"{column_name(k)}1", x, 1) for k, x in enumerate(labels))]
    for row in rows:
        values = [str(v) if n in AS_TEXT and v is not None else v for n, v in zip(names, row, strict=True)]
        if len(lines) <= 500:
            widths = [max(w, len(str(v)) if v is not None else 0) for w, v in zip(widths, values, strict=True)]
        at = len(lines) + 1
        lines.append("".join(_cell(f"{column_name(k)}{at}", v, 2 if names[k] in AS_TEXT else 0) for k, v in enumerate(values)))
    if len(lines) == 1:
        lines.append("")
    area = f"A1:{column_name(len(names) - 1)}{len(lines)}"
    cols = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{min(max(w + 2, 10), 50)}" customWidth="1"/>' for k, w in enumerate(widths))
    body = "".join(f'<row r="{k + 1}">{x}</row>' for k, x in enumerate(lines))
    heads = "".join(f'<tableColumn id="{k + 1}" name="{escape(x, {chr(34): "&quot;"})}"/>' for k, x in enumerate(labels))
    link = lambda k, kind, to: f'<Relationship Id="rId{k}" Type="{_LINKS}/{kind}" Target="{to}"/>'
    links = lambda *x: f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(x)}</Relationships>'
    kind = lambda part, name: f'<Override PartName="/xl/{part}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{name}+xml"/>'
    files = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kind("workbook", "sheet.main")}{kind("worksheets/sheet1", "worksheet")}{kind("styles", "styles")}{kind("tables/table1", "table")}</Types>',
        "_rels/.rels": links(link(1, "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_SPACE}" xmlns:r="{_LINKS}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": links(link(1, "worksheet", "worksheets/sheet1.xml"), link(2, "styles", "styles.xml")),
        "xl/styles.xml": _STYLES,
        "xl/worksheets/sheet1.xml": f'{_HEAD}<worksheet xmlns="{_SPACE}" xmlns:r="{_LINKS}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols><sheetData>{body}</sheetData><tableParts count="1"><tablePart r:id="rId1"/></tableParts></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": links(link(1, "table", "../tables/table1.xml")),
        "xl/tables/table1.xml": f'{_HEAD}<table xmlns="{_SPACE}" id="1" name="Dados" displayName="Dados" ref="{area}"><autoFilter ref="{area}"/><tableColumns count="{len(labels)}">{heads}</tableColumns><tableStyleInfo name="TableStyleMedium2" showRowStripes="1"/></table>',
    }
    return packed({n: x.encode() for n, x in files.items()})


def packed(files: dict[str, bytes]) -> bytes:
    """A zip archive; its bytes hang on the files only."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in files.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            archive.writestr(info, data)
    return out.getvalue()


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """The cells of a workbook's sheet as text, row by row: what was written, read back."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("xl/worksheets/sheet1.xml"))
    out = []
    for row in root.iter(f"{{{_SPACE}}}row"):
        cells: dict[str, str | None] = {}
        for c in row:
            text = c.find(f"{{{_SPACE}}}is/{{{_SPACE}}}t")
            value = c.find(f"{{{_SPACE}}}v")
            cells[re.sub(r"\d", "", c.get("r"))] = text.text if text is not None else value.text if value is not None else None
        last = max(map(_number, cells), default=-1)
        out.append([cells.get(column_name(k)) for k in range(last + 1)])
    return out


def _number(name: str) -> int:
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbooks(df: DataFrame, part: str, order: list[str], columns: dict[str, str], sheet: str = "Dados") -> DataFrame:
    """part, rows and content: one workbook for each part, made by the task that holds it. Parts are bounded before (see selection_parts)."""
    kind = dict(df.dtypes)[part]
    rows = df.select(part, *[F.col(c) for c in columns], *[F.col(o).alias(f"__{k}") for k, o in enumerate(order)])

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values([f"__{k}" for k in range(len(order))], kind="stable")
        own = table[list(columns)].astype(object).where(table[list(columns)].notna(), None)
        return pd.DataFrame({part: [table[part].iloc[0]], "rows": [len(table)], "content": [workbook(own.itertuples(index=False, name=None), columns, sheet)]})

    return rows.groupBy(part).applyInPandas(run, f"{part} {kind}, rows long, content binary")
