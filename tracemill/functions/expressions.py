"""SQL expressions that Spark has no function for, as text for both engines where they share the dialect."""


def gcd(a: str, b: str) -> str:
    """Spark SQL for the greatest common divisor of two 64-bit numbers: Euclid's steps, of which these need fewer than 92."""
    step = "(s, i) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END"
    return f"aggregate(sequence(1, 92), named_struct('a', CAST({a} AS BIGINT), 'b', CAST({b} AS BIGINT)), {step}, s -> s.a)"


def cumulated(name: str, group: str, value: str, source: str) -> str:
    """A table expression of a group's distinct values, with how many rows lie at or below each, and of all rows.

    What is sorted are distinct values, not rows; `at` reads order statistics from it.
    """
    return f"{name} AS (SELECT {group}, {value} AS v, CAST(SUM(COUNT(*)) OVER (PARTITION BY {group} ORDER BY {value}) AS BIGINT) AS upto, CAST(SUM(COUNT(*)) OVER (PARTITION BY {group}) AS BIGINT) AS n FROM {source} GROUP BY {group}, {value})"


def at(rank: str) -> str:
    """The value of the row with this rank from 1, within a group of a `cumulated` table."""
    return f"MIN(v) FILTER (WHERE upto >= {rank})"
