"""Rows with the cases that every operator has to take, and brute-force helpers."""

from __future__ import annotations

import re
import zlib

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"

WORDS = "The quick brown fox jumps over the lazy dog while seven wizards mix a potion of jade and quartz".split()
LONG = " ".join(f"w{k % 97}x{k % 31}" for k in range(60_000))

# Nulls in each column, empty and blank and very long texts, ties and repeated rows.
ROWS = [
    (1, "Hello, World. It's FINE;\ttwo  lines\nhere", "en", "a"),
    (2, None, "en", "b"),
    (3, "", None, "b"),
    (4, " \n\t ", "de", None),
    (5, LONG, "en", "a"),
    (None, "a text without a number of its own", "fr", "c"),
    (6, "über Größe und École, déjà vu. ΣΑΣ 漢字 🙂", "de", ""),
    (7, " ".join(WORDS), "en", "a"),
    (7, " ".join(WORDS), "en", "a"),
    (8, " ".join(WORDS), "en", "a"),
    (9, " ".join(WORDS[:-1]), "en", "a"),
    (9, "the same number, another text", "en", "d"),
    (10, "one", "es", "d"),
]

# Names that operators use for columns of their own.
CLASHING = {
    name: "1"
    for name in "n_words spans items score fp copy key h part start ids chunk size word row taken label positive lang_pred keep text_hash".split()
}

SCHEMA = "doc_id bigint, text string, lang string, source string"


def frame(spark, rows=ROWS, clashing=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()}) if clashing else df


def table(name: str) -> list[dict]:
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def remainder(doc_id, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def fold(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))
