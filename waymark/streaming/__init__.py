"""Structured Streaming forms of the queues, budgets and ledgers in waymark.operators.stateful."""
