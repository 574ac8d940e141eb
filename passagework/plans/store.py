"""A folder of corpora with the three calls a user makes: add, extend, ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.functions.encoders import EncoderFactory, HashingEncoder
from passagework.functions.vectors import DEFAULT_DIM
from passagework.operators.prompt import DEFAULT_TEMPLATE
from passagework.operators.search import DEFAULT_RESULTS
from passagework.plans import ingest as ing
from passagework.plans import retrieve as ret
from passagework.sources import corpus


class DocumentStore:
    """Corpora under ``root``; documents come as ``doc_id, document_name, text``, or as files with an extractor."""

    def __init__(self, spark: SparkSession, root: str, factory: EncoderFactory = HashingEncoder, dim: int = DEFAULT_DIM):
        self.spark = spark
        self.root = root
        self.factory = factory
        self.dim = dim

    def create(self, docs: DataFrame, **options) -> ing.IngestReport:
        """Store corpora that do not exist yet; existing ones are left as they are. Options are those of ``ingest``."""
        return ing.ingest(docs, self.root, only_new_names=True, factory=self.factory, **options)

    def extend(self, docs: DataFrame, **options) -> ing.IngestReport:
        """Add documents to corpora, new or existing. Adding twice stores twice."""
        return ing.ingest(docs, self.root, factory=self.factory, **options)

    def corpus(self, document_name: str) -> DataFrame:
        return corpus.open_corpus(self.spark, self.root, document_name)

    def ask(
        self,
        text: str,
        document_name: str,
        n_results: int = DEFAULT_RESULTS,
        template: str = DEFAULT_TEMPLATE,
    ) -> DataFrame:
        """``query, results`` for one question; the results are the filled prompt."""
        request = self.spark.createDataFrame([(0, text, n_results)], "qid bigint, text string, n_results int")
        rows = ret.answer(self.corpus(document_name), request, template, factory=self.factory, dim=self.dim)
        return rows.select("query", "results")

    def ask_many(self, requests: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
        """``qid, query, results`` for ``qid, text, document_name[, n_results]`` rows, in one search.

        A missing name, or one without a corpus, is an error.
        """
        unknown = corpus.first_unknown(requests, self.root)
        if unknown is not None:
            if not unknown:
                raise ValueError("a document name is required")
            raise corpus.CorpusNotFound(f"no corpus named {unknown!r} at {self.root}")
        table = corpus.read(self.spark, self.root)
        return ret.answer(table, requests, template, factory=self.factory, dim=self.dim)
