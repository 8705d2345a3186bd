"""Answers of a remote model as a batch plan: asked once per distinct prompt, cached, validated."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.text import name_key
from lorewright.operators.context import render_prompt, validated_response

#: Made once per task; gets a prompt and returns a JSON-like dict or None.
Factory = Callable[[], Callable[[str], dict | None]]


def stub() -> Callable[[str], dict | None]:
    """The deterministic stand-in: no answer is ever certain."""
    return lambda prompt: {"speaker": "Unknown", "confidence": 0.5, "is_new_character": False}


def keyed(segments: DataFrame, model: str = "stub", version: str = "v2") -> DataFrame:
    """row_id, key and prompt of the speech rows; the key covers prompt, model and version."""
    p = render_prompt(segments)
    return p.select("row_id", F.sha2(F.concat_ws("\x1f", "prompt", F.lit(model), F.lit(version)), 256).alias("key"), "prompt")


def ask(prompts: DataFrame, cache: DataFrame, factory: Factory = stub) -> DataFrame:
    """key, answer (JSON) for every prompt: from the cache, else from the model, once per distinct key.

    A failed call gives no row, so it is asked again next time.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            out = []
            for key, prompt in zip(pdf["key"], pdf["prompt"]):
                try:
                    answer = client(prompt)
                except Exception:
                    answer = None
                if answer is not None:
                    out.append((key, json.dumps(answer, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["key", "answer"])

    wanted = prompts.select("key", "prompt").dropDuplicates(["key"])
    fresh = wanted.join(cache.select("key"), "key", "left_anti").mapInPandas(call, "key string, answer string")
    return cache.select("key", "answer").join(wanted.select("key"), "key", "left_semi").unionByName(fresh)


def answers(segments: DataFrame, cache: DataFrame, factory: Factory = stub, **kw) -> DataFrame:
    """row_id, speaker, confidence, is_new of the rows with a valid answer."""
    prompts = keyed(segments, **kw)
    got = ask(prompts, cache, factory).select("key", validated_response(F.col("answer")).alias("r")).where("r IS NOT NULL")
    return prompts.select("row_id", "key").join(got, "key").select("row_id", "r.*")


def valid_description(c: Column) -> Column:
    """(description, traits) of a JSON answer: at most 600 characters, and at most eight traits of 80; else null."""
    j = F.from_json(c, "description string, personality_traits array<string>")
    traits = j.personality_traits
    ok = j.description.isNotNull() & (F.size(traits) <= 8) & ~F.exists(traits, lambda t: t.isNull() | (F.length(t) > 80))
    return F.when(ok, F.struct(F.left(j.description, F.lit(600)).alias("description"), traits.alias("traits")))


def visible_aliases(names: DataFrame, chapter: int, most: int = 3) -> DataFrame:
    """Per character the first names visible by a chapter, as a map from name key to canonical name."""
    n = F.row_number().over(Window.partitionBy("book_id", "char_id").orderBy("known_from", "key"))
    rows = names.where((F.col("known_from") <= chapter) & (F.col("key") != name_key(F.col("canonical_name")))).withColumn("n", n).where(F.col("n") <= most)
    return rows.groupBy("book_id", "char_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "canonical_name")))).alias("aliases"))
