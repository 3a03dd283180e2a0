"""Model prompts and replies in batches: request bodies, reply status and text.

The sending itself is no data work: requests leave as a table, replies come back as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as tx

# The instructions of each task, the label of a draft.
INSTRUCTIONS = {
    "summarize": "Summarize the following text concisely, in the same language it is written in.",
    "translate": "Translate the following text to {target}. Output only the translation.",
    "classify": (
        "Classify the following text into exactly one of these categories: {categories}. "
        "Output only the category name."
    ),
    "draft": "",
}
DRAFT_LABEL = "[local-model draft, verify before use]\n"

_REPLY = "struct<choices: array<struct<message: struct<content: string>>>>"


def chat_requests(texts: DataFrame, task: str, model: str, **details: str) -> DataFrame:
    """(id, body) from (id, text): the JSON request of a task; `draft` sends no instruction."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    system = INSTRUCTIONS[task].format(**details)
    messages = [message("user", F.col("text"))]
    if system:
        messages.insert(0, message("system", F.lit(system)))
    body = F.struct(F.lit(model).alias("model"), F.array(*messages).alias("messages"))
    return texts.select("id", F.to_json(body).alias("body"))


def chat_results(
    responses: DataFrame, configured: Column | None = None, reply_limit: int | None = None, unexpected_limit: int | None = None
) -> DataFrame:
    """(id, status, text) from (id, http_status, body).

    No HTTP status means no answer came. An answer of another shape is shown as it came. The limits,
    if given, cut texts of either kind.
    """
    cut = lambda text, limit: text if limit is None else tx.cap_text(text, limit)
    http = F.col("http_status")
    content = F.from_json("body", _REPLY)["choices"]
    first = F.try_element_at(content, F.lit(1))["message"]["content"]
    ready = F.lit(True) if configured is None else configured
    status = (
        F.when(~ready, "not configured")
        .when(http.isNull(), "unavailable")
        .when(http.isin(401, 403), "unauthorized")
        .when(~http.between(200, 299), "error")
        .when(F.col("_content").isNull(), "unexpected")
        .otherwise("draft")
    )
    text = (
        F.when(F.col("status") == "draft", cut(F.concat(F.lit(DRAFT_LABEL), "_content"), reply_limit))
        .when(F.col("status") == "unexpected", cut(F.col("body"), unexpected_limit))
    )
    return responses.withColumn("_content", first).withColumn("status", status).select("id", "status", text.alias("text"))


def status_counts(results: DataFrame) -> DataFrame:
    """(status, n)."""
    return results.groupBy("status").agg(F.count("*").alias("n"))
