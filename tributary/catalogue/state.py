"""Stored tables of many runs, derived from the line items: one run per supplier.

The expressions are plain SQL and serve both sides of the check.
"""

from __future__ import annotations

from ..plans.exports import table

REF = "'id:' || CAST(l_orderkey AS STRING)"
LINE = "l_orderkey * 10 + l_linenumber"

STATE = {
    "runs": ("supplier", {
        "run_id": "s_suppkey", "name": "s_name",
        "status": "CASE s_suppkey % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'awaiting_review' WHEN 2 THEN 'ready_to_push' ELSE 'completed' END",
    }),
    "records": ("lineitem", {
        "run_id": "l_suppkey", "record_id": LINE, "natural_key": f"{REF} || '/' || CAST(l_linenumber AS STRING)",
        "status": (
            "CASE CAST(l_quantity AS BIGINT) % 8 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'valid' WHEN 2 THEN 'pushed' WHEN 3 THEN 'push_failed' "
            "WHEN 4 THEN 'invalid' WHEN 5 THEN 'rolled_back' WHEN 6 THEN 'clean' ELSE 'valid' END"
        ),
        "full_name": "CASE WHEN l_linenumber = 3 THEN ' ' ELSE 'Item ' || CAST(l_partkey AS STRING) END",
        "employee_id": "CASE WHEN l_partkey % 41 = 0 THEN ' ' ELSE 'E' || CAST(l_partkey AS STRING) END",
        "email": "CASE WHEN l_linenumber % 5 = 0 THEN 'x' || CAST(l_partkey AS STRING) || '@GMAIL.com' ELSE 'x@acme.com' END",
        "department": "CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber = 6 THEN '' ELSE l_returnflag END",
    }),
    "results": ("lineitem", {
        "run_id": "l_suppkey", "record_id": "l_orderkey * 10 + 1 + l_linenumber % 3", "attempt": "l_linenumber",
        "status": "CASE WHEN l_returnflag = 'A' THEN 'failed' ELSE 'success' END",
    }),
    "mappings": ("lineitem", {
        "run_id": "l_suppkey", "file": "'part_' || CAST(l_partkey AS STRING)", "header": "'h' || CAST(l_linenumber AS STRING)",
        "status": "CASE l_returnflag WHEN 'A' THEN 'auto_applied' WHEN 'N' THEN 'escalated' ELSE 'resolved' END",
        "method": "CASE WHEN l_linestatus = 'F' THEN 'llm' ELSE 'alias' END",
    }),
    "questions": ("lineitem", {
        "run_id": "l_suppkey", "id": LINE, "created_at": "l_shipdate",
        "type": (
            "CASE l_linenumber % 6 WHEN 0 THEN 'ambiguous_mapping' WHEN 1 THEN 'value_conflict' WHEN 2 THEN 'validation_failure' "
            "WHEN 3 THEN 'manager_unresolved' WHEN 4 THEN 'unmapped_column' ELSE 'ambiguous_date' END"
        ),
        "entity_ref": f"{REF} || ':f' || CAST(l_linenumber AS STRING)", "record": f"{REF} || '/' || CAST(l_linenumber AS STRING)",
        "status": "CASE l_returnflag WHEN 'A' THEN 'open' WHEN 'N' THEN 'resolved' ELSE 'rejected' END",
        "resolved_by": "CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_linestatus = 'F' THEN 'agent' ELSE 'consultant' END",
    }),
    "raised": ("lineitem", {
        "run_id": "l_suppkey", "pos": f"({LINE}) * 1000000 + l_partkey",
        "type": (
            "CASE l_linenumber % 6 WHEN 0 THEN 'ambiguous_mapping' WHEN 1 THEN 'value_conflict' WHEN 2 THEN 'validation_failure' "
            "WHEN 3 THEN 'manager_unresolved' WHEN 4 THEN 'unmapped_column' ELSE 'ambiguous_date' END"
        ),
        "entity_ref": f"{REF} || ':f' || CAST(l_linenumber - l_linenumber % 2 AS STRING)", "note": "CAST(l_partkey AS STRING)",
    }),
    "audit": ("lineitem", {
        "run_id": "l_suppkey", "id": LINE, "ts": "l_shipdate",
        "actor": "CASE WHEN l_linestatus = 'F' THEN 'agent' ELSE 'human' END",
        "action": (
            "CASE l_linenumber WHEN 1 THEN 'cleaned_value' WHEN 2 THEN 'activity:mapping' WHEN 3 THEN 'activity:validate:all' WHEN 4 THEN "
            "'resolved_conflict' WHEN 5 THEN 'escalated' WHEN 6 THEN 'mapped_column' ELSE 'resolved_value_conflict' END"
        ),
        "reason": "'part ' || CAST(l_partkey AS STRING)",
    }),
}


def state(spark, sf_dir: str, name: str):
    base, cols = STATE[name]
    return table(spark, sf_dir, base).selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])


def state_sql(*names: str) -> str:
    """CTEs of the named tables."""
    return ", ".join(
        f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in STATE[n][1].items())} FROM {STATE[n][0]})" for n in names
    )
