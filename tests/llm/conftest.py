import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def mixed(spark):
    """Documents with every awkward case: nulls, empty and long texts, repeated and tied rows, clashing extra columns."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards mix potent liquids and " * 3
    rows = [(1, base, "en"), (2, base, "en"), (3, base + "again now", "en"), (4, None, "en"), (5, "", None), (6, "   \n", "fr"), (7, "un deux trois", "fr"),
            (8, "le chat mange la souris et le chien dort dans la maison " * 4, "fr"), (9, "x" * 5000, None), (10, "short", "en"), (11, "short", "en"),
            (12, " ".join(f"w{i % 97}q{i}" for i in range(9000)), "en"), (None, "no id here", "en"), (13, "123 456 !!", "en"), (13, "123 456 !!", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "'s' AS source", "1L AS key", "2 AS size", "'x' AS shard", "3L AS slot", "0 AS piece", "9L AS sequence_id", "'y' AS bits", "'z' AS score", "7 AS part", "'r' AS range")
