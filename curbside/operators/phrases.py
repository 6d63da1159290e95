"""Many short phrases looked for in many texts at once, by Aho-Corasick automata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from curbside.runtime import cut

#: Phrases and characters of one automaton, at most about; a worker builds it once a task.
PHRASES, CHARACTERS = 100_000, 8_000_000


def texts_with(texts: DataFrame, text_col: str, phrases: DataFrame, id_col: str, phrase_col: str, most: int = PHRASES) -> DataFrame:
    """(id, n_texts) of the phrases that a text contains; an empty phrase is in every text.

    The phrases are dealt to automata of a bounded size, and the texts stream
    through each; a text isn't shuffled. A task hands on one count a phrase.
    """
    import ahocorasick

    spark = texts.sparkSession
    rows = phrases.select(id_col, F.col(phrase_col).alias("phrase")).filter("phrase IS NOT NULL")
    rows = cut(rows.withColumn("num", F.monotonically_increasing_id()), "phrases")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("phrase")), F.lit(0)).alias("c")).first()
    parts = max(1, -(-size.n // most), -(-size.c // CHARACTERS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("num"), F.lit(parts)))
    out = rows.filter("phrase = ''").join(texts.agg(F.count(text_col).alias("n_texts")), F.lit(True)).select(id_col, "n_texts")  # a single row
    for part in range(parts):
        held = [(r.num, r.phrase) for r in rows.filter((F.col("part") == part) & (F.col("phrase") != "")).select("num", "phrase").collect()]
        shared = spark.sparkContext.broadcast(held)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers: dict[str, list[int]] = {}
            for num, phrase in shared.value:
                numbers.setdefault(phrase, []).append(num)
            automaton = ahocorasick.Automaton()
            for phrase in numbers:
                automaton.add_word(phrase, phrase)
            if not numbers:
                return
            automaton.make_automaton()
            found = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    if text:
                        found.update({phrase for _, phrase in automaton.iter(text)})
            pairs = [(num, n) for phrase, n in found.items() for num in numbers[phrase]]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["num", "n"])

        counts = texts.select(text_col).mapInArrow(search, "num long, n long").groupBy("num").agg(F.sum("n").alias("n_texts"))
        out = out.unionByName(rows.join(counts, "num").select(id_col, "n_texts"))
    return out.filter("n_texts > 0")
