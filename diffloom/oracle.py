"""The comparison in plain SQL for DuckDB: a full outer join of the tables and nothing clever.

It knows neither hashes nor masks, so it is an independent check. Only the
grouping of columns is shared, since candidates of a column are rows in which
any column of its group differs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class OracleColumn:
    name: str
    kind: str
    group: int = 0
    tolerance: float = 0.0
    norm: str = "{}"  # normalisation of a value for comparison

    @property
    def numeric(self) -> bool:
        return self.kind in ("double", "bigint", "int")

    def norms(self) -> tuple[str, str]:
        return self.norm.format(f"l_{self.name}"), self.norm.format(f"r_{self.name}")

    @property
    def differs(self) -> str:
        a, b = self.norms()
        return f"({a} IS DISTINCT FROM {b})"

    @property
    def mismatch(self) -> str:
        a, b = self.norms()
        if not self.numeric:
            return self.differs
        return f"(({a} IS NULL) <> ({b} IS NULL) OR coalesce(abs(CAST({b} AS DOUBLE) - CAST({a} AS DOUBLE)) > {self.tolerance}, FALSE))"

    @property
    def abs_diff(self) -> str:
        return f"round(abs(CAST(r_{self.name} AS DOUBLE) - CAST(l_{self.name} AS DOUBLE)), 4)" if self.numeric else "CAST(NULL AS DOUBLE)"


@dataclass(frozen=True)
class Oracle:
    """tables: CTEs that define l and r; key: text of a batch key."""

    tables: str
    keys: Sequence[str]
    batch: str
    columns: Sequence[OracleColumn]
    key: str = "strftime({}, '%Y-%m-%d')"

    @property
    def ctes(self) -> str:
        every = [*self.keys, *(c.name for c in self.columns)]
        sides = ", ".join(f"{s}.{c} AS {s}_{c}" for c in every for s in "lr")
        on = " AND ".join(f"l.{k} = r.{k}" for k in self.keys)
        there = {s: " AND ".join(f"{s}_{k} IS NOT NULL" for k in self.keys) for s in "lr"}
        changed = " OR ".join(c.differs for c in self.columns)
        groups = ", ".join(f"({' OR '.join(c.differs for c in self.columns if c.group == g)}) AS g_{g}" for g in sorted({c.group for c in self.columns}))
        keys = ", ".join(f"coalesce(l_{k}, r_{k}) AS k_{k}" for k in self.keys)
        return f"""WITH {self.tables},
f AS (SELECT {sides} FROM l FULL OUTER JOIN r ON {on}),
j AS (SELECT *, {keys}, {self.key.format(f"coalesce(l_{self.batch}, r_{self.batch})")} AS batch_key,
 CASE WHEN {there["l"]} AND {there["r"]} THEN 'matched' WHEN {there["l"]} THEN 'left_only' WHEN {there["r"]} THEN 'right_only' ELSE 'unknown' END AS row_status,
 {groups} FROM f),
b AS (SELECT batch_key, CAST(count(*) FILTER (row_status IN ('matched', 'left_only')) AS BIGINT) AS left_row_count, CAST(count(*) FILTER (row_status IN ('matched', 'right_only')) AS BIGINT) AS right_row_count,
 CAST(count(*) FILTER (row_status = 'matched') AS BIGINT) AS matched_row_count, CAST(count(*) FILTER (row_status <> 'matched' OR {changed}) AS BIGINT) AS odd FROM j GROUP BY batch_key)"""

    def batch_status(self) -> str:
        return f"""{self.ctes} SELECT batch_key, CASE WHEN left_row_count = 0 THEN 'right_only' WHEN right_row_count = 0 THEN 'left_only' WHEN odd = 0 THEN 'identical' ELSE 'changed' END AS batch_status,
 NULLIF(left_row_count, 0) AS left_row_count, NULLIF(right_row_count, 0) AS right_row_count FROM b"""

    def row_status_counts(self) -> str:
        return f"{self.ctes} SELECT batch_key, row_status, CAST(count(*) AS BIGINT) AS row_count FROM j GROUP BY ALL"

    def row_status_totals(self) -> str:
        return f"{self.ctes} SELECT row_status, CAST(count(*) AS BIGINT) AS row_count FROM j GROUP BY ALL"

    def row_status_detail(self) -> str:
        """Of changed batches only."""
        keys = ", ".join(f"k_{k} AS {k}" for k in self.keys)
        return f"{self.ctes} SELECT {keys}, row_status FROM j JOIN b USING (batch_key) WHERE odd > 0 AND left_row_count > 0 AND right_row_count > 0"

    def changed_keys(self) -> str:
        keys = ", ".join(f"k_{k} AS {k}" for k in self.keys)
        flags = ", ".join(f"NOT g_{g} AS gh_{g}_match" for g in sorted({c.group for c in self.columns}))
        return f"{self.ctes} SELECT {keys}, {flags} FROM j WHERE row_status = 'matched' AND ({' OR '.join(f'g_{g}' for g in sorted({c.group for c in self.columns}))})"

    def group_changes(self) -> str:
        parts = [f"SELECT batch_key, {g} AS group_index, CAST(count(*) AS BIGINT) AS changed_row_count FROM j WHERE row_status = 'matched' AND g_{g} GROUP BY batch_key" for g in sorted({c.group for c in self.columns})]
        return f"{self.ctes} {' UNION ALL '.join(parts)}"

    def nonnull_counts(self) -> str:
        parts = [
            f"SELECT batch_key, '{c.name}' AS \"column\", CAST(count(*) FILTER (l_{c.name} IS NOT NULL AND r_{c.name} IS NOT NULL) AS BIGINT) AS nonnull_count FROM j WHERE row_status = 'matched' GROUP BY batch_key"
            for c in self.columns
        ]
        return f"{self.ctes} {' UNION ALL '.join(parts)}"

    def _summary(self) -> str:
        parts = []
        for c in self.columns:
            parts.append(
                f"""SELECT batch_key, '{c.name}' AS "column", '{c.kind}' AS left_type, '{c.kind}' AS right_type, {str(c.numeric).upper()} AS is_numeric, CAST({c.tolerance} AS DOUBLE) AS tolerance,
 CAST(count(*) FILTER (g_{c.group}) AS BIGINT) AS changed_row_count, CAST(count(*) FILTER (l_{c.name} IS NOT NULL AND r_{c.name} IS NOT NULL) AS BIGINT) AS nonnull_compared_count,
 CAST(count(*) FILTER (g_{c.group} AND {c.mismatch}) AS BIGINT) AS mismatch_count,
 CAST(count(*) FILTER (g_{c.group} AND (l_{c.name} IS NULL) <> (r_{c.name} IS NULL)) AS BIGINT) AS null_mismatch_count,
 max({c.abs_diff}) FILTER (g_{c.group}) AS max_abs_diff, CAST(count(*) AS BIGINT) AS matched_row_count FROM j WHERE row_status = 'matched' GROUP BY batch_key"""
            )
        return f"s AS ({' UNION ALL '.join(parts)})"

    def summary_by_batch(self) -> str:
        return f"""{self.ctes}, {self._summary()} SELECT *, mismatch_count / matched_row_count AS mismatch_pct, null_mismatch_count / matched_row_count AS null_mismatch_pct FROM s"""

    @property
    def _totals(self) -> str:
        return f"""{self._summary()}, t AS (SELECT "column", left_type, right_type, is_numeric, tolerance, CAST(sum(matched_row_count) AS BIGINT) AS matched_row_count, CAST(sum(nonnull_compared_count) AS BIGINT) AS nonnull_compared_count,
 CAST(sum(mismatch_count) AS BIGINT) AS mismatch_count, sum(mismatch_count) / sum(matched_row_count) AS mismatch_pct, CAST(sum(null_mismatch_count) AS BIGINT) AS null_mismatch_count,
 sum(null_mismatch_count) / sum(matched_row_count) AS null_mismatch_pct, max(max_abs_diff) AS max_abs_diff FROM s GROUP BY ALL)"""

    def summary_of_all(self) -> str:
        return f"{self.ctes}, {self._totals} SELECT * FROM t"

    def noisy_columns(self, threshold: float) -> str:
        return f"""{self.ctes}, {self._totals} SELECT "column", matched_row_count, mismatch_count, mismatch_pct, 'change_rate_above_threshold' AS suspected_reason FROM t WHERE mismatch_pct >= {threshold}"""

    def cell_rollup(self) -> str:
        return f"""{self.ctes}, {self._summary()} SELECT batch_key, CAST(sum(matched_row_count) AS BIGINT) AS cell_count, CAST(sum(mismatch_count) AS BIGINT) AS mismatch_count, sum(mismatch_count) / sum(matched_row_count) AS mismatch_pct FROM s GROUP BY batch_key"""

    def without_noise(self, threshold: float) -> str:
        return f"""{self.ctes}, {self._totals} SELECT s.*, mismatch_count / matched_row_count AS mismatch_pct, null_mismatch_count / matched_row_count AS null_mismatch_pct FROM s WHERE "column" NOT IN (SELECT "column" FROM t WHERE mismatch_pct >= {threshold})"""

    def top_columns(self, n: int) -> str:
        return f"""{self.ctes}, {self._totals} SELECT * FROM t ORDER BY mismatch_count DESC, "column" LIMIT {n}"""

    def by_rate(self) -> str:
        return f"""{self.ctes}, {self._totals} SELECT "column", mismatch_pct, mismatch_count, matched_row_count FROM t"""

    def _cells(self) -> str:
        keys = ", ".join(f"k_{k} AS {k}" for k in self.keys)
        parts = []
        for c in self.columns:
            a, b = f"CAST(l_{c.name} AS DOUBLE)", f"CAST(r_{c.name} AS DOUBLE)"
            d = f"({b} - {a})" if c.numeric else "CAST(NULL AS DOUBLE)"
            ratio = f"CASE WHEN {a} <> 0 THEN {d} / {a} END" if c.numeric else "CAST(NULL AS DOUBLE)"
            parts.append(
                f"""SELECT {keys}, '{c.name}' AS "column", CAST(l_{c.name} AS VARCHAR) AS old_value, CAST(r_{c.name} AS VARCHAR) AS new_value, (l_{c.name} IS NULL) <> (r_{c.name} IS NULL) AS null_mismatch,
 round({d}, 4) AS diff, round(abs({d}), 4) AS abs_diff, round({ratio}, 4) AS pct_diff, round(100 * ({ratio}), 4) AS pct_diff_pct, CAST({c.tolerance} AS DOUBLE) AS tolerance_used
 FROM j WHERE row_status = 'matched' AND g_{c.group} AND {c.mismatch}"""
            )
        return f"c AS ({' UNION ALL '.join(parts)})"

    def mismatch_detail(self) -> str:
        return f"{self.ctes}, {self._cells()} SELECT * FROM c"

    def mismatch_sample(self, n: int, column: str | None = None) -> str:
        only = f""" AND "column" = '{column}'""" if column else ""
        return f"""{self.ctes}, {self._cells()} SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY {self.batch}, "column" ORDER BY {", ".join(self.keys)}) AS place FROM c) WHERE place <= {n}{only}"""
