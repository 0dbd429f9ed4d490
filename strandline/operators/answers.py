"""[LLM-*, RAG-1] Prompts, offline model providers, file summaries and sourced answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.functions.retry import with_retry
from strandline.operators import embedding, search

UNAVAILABLE = "Summary unavailable"


def context_block(nth: Column) -> Column:
    """[SCL-12] One chunk of the prompt's context, from columns file, name, start_line, end_line and code."""
    head = F.concat(F.lit("[part "), nth.cast("string"), F.lit("] "), F.col("name"), F.lit(" | "), F.col("file"), F.lit(" | "), F.concat_ws("-", "start_line", "end_line"))
    return F.concat(head, F.lit("\n"), F.col("code"), F.lit("\n\n"))


def build_prompt(question: Column, context: Column) -> Column:
    """[SCL-12] Instructions, context and question; the reply is to be JSON."""
    reply = json.dumps({"answer": "...", "sources": [{"file": "...", "name": "...", "type": "...", "start_line": 1, "end_line": 1}]})
    return F.concat(
        F.lit("Answer the question from the code context alone. If it is not there, say that no relevant code was found. Name every source.\n\n"),
        F.lit("Parts of the code:\n\n"), context, F.lit("The question: "), question,
        F.lit(f"\n\nReply with JSON of this form and nothing else:\n{reply}\n"),
    )


def summary_prompt(path: Column, imports: Column, exports: Column, skeleton: Column) -> Column:
    """[SCL-13]"""
    parts = [("file_name", path), ("import statements", F.to_json(imports)), ("export statements", F.to_json(exports)), ("file skeleton", F.array_join(skeleton, "\n"))]
    return F.concat(F.lit("Summarise this file in at most four sentences.\n"), *(F.concat(F.lit(f"\n{label}: "), value) for label, value in parts))


def offline_summary(path: Column, imports: Column, skeleton: Column) -> Column:
    """[LLM-1] An extractive summary; a fixed text where there is nothing to say."""
    said = F.concat(path, F.lit(" declares "), F.size(skeleton), F.lit(" parts and has "), F.size(imports), F.lit(" imports. First: "), F.get(skeleton, F.lit(0)))
    return F.when(F.size(skeleton) > 0, said).otherwise(UNAVAILABLE)


_PART = re.compile(r"\[part \d+\] (.*) \| (.*) \| (\d+)-(\d+)")


def offline_model(prompt: str) -> str:
    """Names the chunks of the context as sources."""
    found = [m.groups() for m in map(_PART.fullmatch, prompt.split("\n")) if m]
    sources = [{"file": file, "name": name, "type": "", "start_line": int(first), "end_line": int(last)} for name, file, first, last in found]
    answer = f"The nearest code is {sources[0]['name']} in {sources[0]['file']}." if sources else "No relevant code was found."
    return json.dumps({"answer": answer, "sources": sources})


#: [LLM-2] Models by name: prompt -> reply.
MODELS: dict[str, Callable[[str], str]] = {"offline": offline_model}


def ask(prompts: Column, model: str = "offline") -> Column:
    """[LLM-2] The reply to each prompt."""
    of = MODELS[model]

    @F.pandas_udf("string")
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda p: None if p is None else with_retry(lambda: of(p), embedding.ATTEMPTS, (1.0, 10.0)))

    return run(prompts)


def summarise(prompts: Column, model: str, wait: tuple[float, float] = (1.0, 10.0)) -> Column:
    """[LLM-1] A model's summary for each prompt of ``summary_prompt``; a fixed text where it fails at every attempt or says nothing."""
    of = MODELS[model]

    def one(prompt: str) -> str:
        try:
            return with_retry(lambda: of(prompt), embedding.ATTEMPTS, wait) or UNAVAILABLE
        except Exception:
            return UNAVAILABLE

    @F.pandas_udf("string")
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda p: UNAVAILABLE if p is None else one(p))

    return run(prompts)


def answer_question(points: DataFrame, question: str, k: int = 5, provider: str = "hashing", model: str = "offline") -> DataFrame:
    """[RAG-1] One row (question, answer, sources) for a question over the points of one repository."""
    best = search.top_k(points, embedding.embed_question(question, provider), k).select("file", "name", "start_line", "end_line", "code", "score", "point_id")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "point_id", "file", "name", "start_line", "end_line", "code")))
    blocks = best.agg(ranked.alias("hits")).select(F.posexplode_outer("hits").alias("i", "hit")).select("i", "hit.*")
    context = blocks.agg(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("file").isNotNull(), context_block(F.col("i") + 1)).otherwise("").alias("t")))).alias("b"))
    prompt = context.select(build_prompt(F.lit(question), F.array_join(F.transform("b", lambda x: x["t"]), "")).alias("prompt"))
    reply = T.parse_reply(ask(F.col("prompt"), model))
    return prompt.select(F.lit(question).alias("question"), reply.alias("reply")).select("question", "reply.answer", "reply.sources")


def response_sources(sources: Column) -> Column:
    """[PRJ-3] Sources as the response names them."""
    return F.transform(sources, lambda s: F.struct(s["file"].alias("fileN"), s["name"].alias("name"), s["start_line"].cast("int").alias("start_line"), s["end_line"].cast("int").alias("end_line")))
