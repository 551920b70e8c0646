"""Deterministic model stand-ins for the completion contract (tests, smoke runs).

Real deployments pass their own ``fn(list[str]) -> list[str | None]`` to
``answer.complete``; these rule-based functions keep results reproducible
without a network.
"""

from __future__ import annotations

import json
import re

_TABLE_RE = re.compile(r"^Table: (\S+)", re.M)
_COLUMN_RE = re.compile(r"^\[field\] \w+\.(\w+) :", re.M)
_DESCRIBED_RE = re.compile(r"^\[table\] (\w+) \(", re.M)
_QUESTION_RE = re.compile(r"^Question: (.*)$", re.M)


def describe(prompts: list[str]) -> list[str | None]:
    """Description model: one sentence from the prompt's subject; declines tables without FKs."""
    out = []
    for p in prompts:
        col = _COLUMN_RE.search(p)
        if col:
            out.append(f"Values of {col.group(1).replace('_', ' ')}.")
            continue
        tab = _DESCRIBED_RE.search(p)
        if tab and "No foreign keys" not in p:
            out.append(f"Rows of {tab.group(1)} linked to other tables.")
        else:
            out.append(None)
    return out


def _fence(sql: str, explanation: str) -> str:
    return "```json\n" + json.dumps({"query": sql, "explanation": explanation}) + "\n```"


def write_sql(prompts: list[str]) -> list[str | None]:
    """SQL model: maps a few question forms to SQL, otherwise previews the best retrieved table."""
    out = []
    for p in prompts:
        qm = _QUESTION_RE.search(p)
        q = qm.group(1) if qm else ""
        ql = q.lower()
        tables = _TABLE_RE.findall(p)
        scoped = re.match(r"about table (\w+): how many rows", ql)
        ev = re.match(r"how many (\w+) events", ql)
        if "most orders" in ql:
            out.append(_fence("SELECT c_custkey, c_name, count(*) AS n_orders FROM customer JOIN orders "
                              "ON o_custkey = c_custkey GROUP BY c_custkey, c_name "
                              "ORDER BY n_orders DESC, c_custkey LIMIT 5", "Customers ranked by order count"))
        elif "revenue" in ql and "category" in ql:
            out.append(_fence("SELECT p_type, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue "
                              "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey "
                              "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
                              "GROUP BY p_type, n_name HAVING sum(l_extendedprice * (1 - l_discount)) > 5000 "
                              "ORDER BY revenue DESC, p_type, n_name", "Revenue by category and country"))
        elif scoped:
            out.append(_fence(f"SELECT count(*) AS n FROM {scoped.group(1)}", "Row count"))
        elif ev:
            out.append(_fence(f"SELECT count(*) AS n FROM events WHERE event_type = '{ev.group(1)}'",
                              "Events of one type"))
        elif "how many" in ql and tables:
            out.append(_fence(f"SELECT count(*) AS n FROM {tables[0]}", "Row count of the best table"))
        elif tables:
            out.append(f"Here is a sample.\n```sql\nSELECT * FROM {tables[0]} LIMIT 5\n```")
        else:
            out.append(None)
    return out


def reuse_similar(prompts: list[str]) -> list[str | None]:
    """SQL model that answers as the most similar stored question was answered; nothing where the prompt holds none."""
    found = [re.search(r"^SQL: (.*)$", p, re.M) for p in prompts]
    return [_fence(m.group(1), "As for a similar question") if m else None for m in found]
