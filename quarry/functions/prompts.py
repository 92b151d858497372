"""Contexts and prompts as Spark columns; the wording of the prompts is our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATES = {
    "cot": "Think step by step, then answer.\nSources:\n{context}\nQuestion: {question}\n",
    "extractive": "Quote only what the sources say.\nSources:\n{context}\nQuestion: {question}\n",
    "citation": "Answer and cite sources as [n].\nSources:\n{context}\nQuestion: {question}\n",
    "few_shot": "Reason as in these examples.\n{examples}Sources:\n{context}\nQuestion: {question}\nReasoning:\n",
    "attributed": "Quote the sources and name each as [Source n].\n{context}\nQuestion: {question}\n",
    "numbered": "Answer in sentences that end in the numbers of their sources.\n{context}\nQuestion: {question}\n",
}


def examples(shown: list[tuple[str, str, str]]) -> str:
    """Numbered examples of a question, its reasoning and its answer."""
    return "".join(f"Example {i}\nQuestion: {q}\nReasoning: {r}\nAnswer: {a}\n\n" for i, (q, r, a) in enumerate(shown, 1))


def prompt(template: str, question: Column, context: Column, shown: list[tuple[str, str, str]] = ()) -> Column:
    """A prompt; unknown templates fall back to step-by-step reasoning. Braces in a question or context stay as they are."""
    t = TEMPLATES.get(template, TEMPLATES["cot"]).replace("{examples}", examples(list(shown)))
    before, after = t.split("{context}")
    between, end = after.split("{question}")
    return F.concat(F.lit(before), context, F.lit(between), question, F.lit(end))


def blocks(sources: Column, line) -> Column:
    """Each of an array of sources (structs, in order) as a block; ``line`` makes one from a source and its number from 1."""
    return F.transform(sources, lambda s, i: line(s, (i + 1).cast("string")))


def attributed(sources: Column) -> Column:
    return F.array_join(blocks(sources, lambda s, i: F.concat(F.lit("[Source "), i, F.lit("] "), s["title"], F.lit(" (Page "), s["page"], F.lit("):\n"), s["text"], F.lit("\n"))), "\n")


def numbered(sources: Column) -> Column:
    return F.array_join(blocks(sources, lambda s, i: F.concat(F.lit("["), i, F.lit("] "), s["title"], F.lit(" (Page "), s["page"], F.lit(", Source: "), s["source"], F.lit("):\n"), s["text"], F.lit("\n"))), "\n")


def chat(sources: Column) -> Column:
    """Blocks of document, section and text between rules."""
    return F.array_join(blocks(sources, lambda s, _: F.concat(F.lit("Document: "), s["title"], F.lit("\nSection: "), s["section"], F.lit("\n"), s["text"])), "\n\n---\n\n")


def with_history(history: Column, documents: Column) -> Column:
    """What there is of an earlier conversation and of documents; null where there is neither."""
    part = lambda head, c: F.when(c != "", F.concat(F.lit(head), c))
    return F.nullif(F.array_join(F.array_compact(F.array(part("Previous Conversation:\n", history), part("Relevant Documents:\n", documents))), "\n\n=====\n\n"), F.lit(""))


#: What is said where nothing relevant was found.
NO_ANSWER = "Nothing was found that answers the question. Put it differently or tell more."


def synthesis(queries: DataFrame, relevant: DataFrame, most: int = 5, chars: int = 300) -> DataFrame:
    """query_id, answerable and prompt: the question with the ``most`` best relevant rows (query_id, place, title, source_type, text), the first ``chars`` characters of each."""
    best = F.slice(F.array_sort(F.collect_list(F.struct("place", "title", "source_type", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text")))), 1, most)
    lines = blocks(F.col("best"), lambda s, i: F.concat(F.lit("["), i, F.lit("] "), s["title"], F.lit(" ("), s["source_type"], F.lit("):\n"), s["text"]))
    context = relevant.groupBy("query_id").agg(best.alias("best")).select("query_id", F.array_join(lines, "\n\n").alias("context"))
    asked = F.concat(F.lit("Answer from the context; cite what comes from the web.\nContext:\n"), "context", F.lit("\nQuestion: "), "query", F.lit("\nAnswer:"))
    there = F.col("context").isNotNull()
    return queries.join(context, "query_id", "left").select("query_id", there.alias("answerable"), F.when(there, asked).otherwise(F.lit(NO_ANSWER)).alias("prompt"))
