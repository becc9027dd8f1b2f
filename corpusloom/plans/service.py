"""Retrieval and answers for a list of questions: what a server would call (IO18, FU4, JS4-JS7)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import answers, retrieval
from corpusloom.plans.config import RetrievalConfig


@dataclass
class Service:
    """Indexes over ``texts(doc_id, text)`` and the settings that every call uses."""

    spark: SparkSession
    texts: DataFrame
    index: retrieval.SparseIndex
    vectors: DataFrame
    encoder: Callable[[list[str]], np.ndarray]
    config: RetrievalConfig = RetrievalConfig()

    def health(self) -> dict:
        return {"status": "ok", "documents": self.index.stats.first()["n_docs"]}

    def questions(self, texts: list[str]) -> DataFrame:
        """``(qid, query, embedding)`` of a list of questions."""
        rows = self.spark.createDataFrame(list(enumerate(texts)), "qid bigint, query string")
        return retrieval.encode(rows, self.encoder, "query")

    def retrieve(self, texts: list[str], top_k: int | None = None, method: str = "hybrid") -> DataFrame:
        """``(qid, query, rank, doc_id, text, score, sources)`` for all questions in one plan."""
        config = self.config if top_k is None else replace(self.config, top_k=top_k)
        asked = self.questions(texts)
        found = retrieval.retrieve(asked, self.index, self.vectors, self.texts, method, config)
        return retrieval.present(found, asked, self.texts)

    def complete(self, chats: DataFrame, top_k: int = 5) -> DataFrame:
        """``(conv_id, response)``: each chat's last user message is searched for and answered from what is found."""
        asked = answers.last_user_message(chats).select(F.col("conv_id").alias("qid"), F.col("text").alias("query"))
        asked = retrieval.encode(asked, self.encoder, "query")
        found = retrieval.retrieve(asked, self.index, self.vectors, self.texts, "hybrid", replace(self.config, top_k=top_k))
        hits = found.join(self.texts.select("doc_id", "text"), "doc_id")
        made = answers.template_answer(hits, asked)
        return made.select(F.col("qid").alias("conv_id"), answers.envelope(F.col("payload")).alias("response"))
