"""Letters, scores and character classes of nucleotide alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The order of the letters, the scores of the first ten against each other (candidate by row, observed by
# column) for consensus calling and for duplicated sites, and the character classes of the file format.
LETTERS = "ARGCYTKMSWNXZVHDB-"
CONSENSUS_CORE = """
  9   0  -8 -15 -16 -17 -13  -3 -11  -4
  2   1   1 -15 -15 -16  -7  -6  -6  -7
 -4   3  10 -14 -14 -15  -2  -9  -2  -9
-15 -14 -14  10   3  -4  -9  -2  -2  -9
-16 -15 -15   1   1   2  -6  -7  -6  -7
-17 -16 -15  -8   0   9  -3 -13 -11  -4
-11  -6  -2 -11  -7  -3  -2 -11  -6  -7
 -3  -7 -11  -2  -6 -11 -11  -2  -6  -7
 -9  -5  -2  -2  -5  -9  -5  -5  -2  -9
 -4  -8 -11 -11  -8  -4  -8  -8 -11  -4
"""
SITE_CORE = """
  9   0  -8 -15 -16 -17 -13  -3 -11  -4
  3   3   3 -15 -15 -16  -7  -6  -6  -7
 -5   3  10 -14 -14 -15  -2  -9  -2  -9
-15 -14 -14  10   3  -5  -9  -2  -2  -9
-16 -15 -15   3   3   3  -6  -7  -6  -7
-17 -16 -15  -8   0   9  -3 -13 -11  -4
-11  -6  -2 -11  -7  -2  -2 -11  -6  -7
 -2  -7 -11  -2  -6 -11 -11  -2  -6  -7
 -9  -5  -2  -2  -5  -9  -5  -5  -2  -9
 -3  -8 -11 -11  -8  -3  -8  -8 -11  -3
"""
GAPS = "-._~"
IUB = "ACGTRYSWKMBDHVN"
KNOWN_GF = ["AC", "AU", "CC", "CN", "CT", "DE", "DR", "ID", "KD", "OC", "RA", "RD", "RL", "RM", "RN", "RT", "SE", "SQ", "TD", "TP", "**"]
KNOWN_GC = ["RF", "MM"]


def consensus_score(candidate: str, observed: str) -> int:
    """Score of a candidate letter against an observed one."""
    if "-" in (candidate, observed):
        return 3 if candidate == observed else -6
    rare = "ZVHDB"
    if candidate in rare or observed in rare:
        return -3
    if "X" in (candidate, observed):
        return -7
    if "N" in (candidate, observed):
        return -1 if candidate == observed else -2
    rows = [list(map(int, line.split())) for line in CONSENSUS_CORE.strip().split("\n")]
    return rows[LETTERS.index(candidate)][LETTERS.index(observed)]


def site_score(candidate: str, observed: str) -> int:
    """The same for the twelve letters of duplicated sites."""
    if "X" in (candidate, observed):
        return -7
    if "N" in (candidate, observed):
        return -2
    rows = [list(map(int, line.split())) for line in SITE_CORE.strip().split("\n")]
    return rows[LETTERS.index(candidate)][LETTERS.index(observed)]


def score_rows(letters: str = LETTERS, score=consensus_score) -> list[tuple[str, int, str, int]]:
    """candidate, its place, observed and score of all pairs of letters."""
    return [(c, i, o, score(c, o)) for i, c in enumerate(letters) for o in letters]


def scores(spark: SparkSession, letters: str = LETTERS, score=consensus_score) -> DataFrame:
    """cand, idx, obs, score; a few hundred rows, whatever the data."""
    return spark.createDataFrame(score_rows(letters, score), "cand string, idx int, obs string, score int")


def is_gap(c):
    """Whether a one-letter column is a gap."""
    return F.instr(F.lit(GAPS), c) > 0
