"""The few spots where Spark SQL and the checking database write the same thing differently."""

from __future__ import annotations


class Dialect:
    def __init__(self, name: str):
        self.spark = name == "spark"

    def date(self, ts: str) -> str:
        """The UTC date of unix seconds."""
        days = f"CAST(floor(({ts}) / 86400.0) AS INT)"
        return f"date_add(DATE'1970-01-01', {days})" if self.spark else f"(DATE '1970-01-01' + {days})"

    def day(self, ts: str) -> str:
        return f"CAST({self.date(ts)} AS {'STRING' if self.spark else 'VARCHAR'})"

    def month(self, ts: str) -> str:
        return f"substr({self.day(ts)}, 1, 7)"

    def year(self, ts: str) -> str:
        return f"CAST(substr({self.day(ts)}, 1, 4) AS INT)"

    def month_of_year(self, ts: str) -> str:
        return f"CAST(substr({self.day(ts)}, 6, 2) AS INT)"

    def weekday(self, ts: str) -> str:
        """0 = Sunday. 1970-01-01 was a Thursday."""
        return f"CAST((floor(({ts}) / 86400.0) + 4) % 7 AS INT)"

    def unix(self, ntz: str) -> str:
        """Whole unix seconds of a timestamp without zone, read as UTC."""
        return f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ntz})" if self.spark else f"CAST(floor(epoch({ntz})) AS BIGINT)"

    def midnight(self, year: str) -> str:
        """Unix seconds of the first second of a year."""
        return f"(86400 * CAST(datediff(make_date({year}, 1, 1), DATE'1970-01-01') AS BIGINT))" if self.spark else f"CAST(epoch(make_date(CAST({year} AS INT), 1, 1)) AS BIGINT)"

    def series(self, low: str, high: str) -> str:
        """Rows x = low .. high; none if high < low."""
        if self.spark:
            return f"(SELECT explode(CASE WHEN {high} >= {low} THEN sequence(CAST({low} AS BIGINT), CAST({high} AS BIGINT)) ELSE array() END) AS x)"
        return f"(SELECT CAST(unnest(generate_series(CAST({low} AS BIGINT), CAST({high} AS BIGINT))) AS BIGINT) AS x)"

    def touched(self, low: str, high: str) -> str:
        """For a SELECT list: one row for each number from low to high."""
        return f"explode(sequence(CAST({low} AS BIGINT), CAST({high} AS BIGINT)))" if self.spark else f"CAST(unnest(generate_series(CAST({low} AS BIGINT), CAST({high} AS BIGINT))) AS BIGINT)"

    def json(self, column: str, path: str) -> str:
        """A JSON path as text, null where the document is malformed."""
        return f"get_json_object({column}, '{path}')" if self.spark else f"(CASE WHEN json_valid({column}) THEN json_extract_string({column}, '{path}') END)"

    def metres(self, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
        """Great-circle distance on a sphere of 6 371 000 m; null if any coordinate is."""
        a = f"power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians(({lon2}) - ({lon1})) / 2), 2)"
        return f"(2 * 6371000.0 * asin(sqrt(CASE WHEN {a} > 1 THEN 1.0 ELSE {a} END)))"

    def pick(self, index: str, values: list[str]) -> str:
        cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
        return f"(CASE {index} {cases} END)"

    def letter(self, number: str) -> str:
        return f"chr(CAST({number} AS INT))"


SPARK, CHECK = Dialect("spark"), Dialect("check")
