"""The engine's surface: what an application calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.segment import segmenter
from docmill.operators import catalog as cat
from docmill.operators.fusion import MOST, smart_search
from docmill.operators.respond import NO_ANSWER, ROUTE_PROMPT, answer, citations, route
from docmill.operators.retrieval import scoped
from docmill.sources.store import Store


class Engine:
    """Search and question answering over a table of chunks and a catalog of files, or over a ``Store``
    (see ``over``), which is read anew by every call.

    ``embed`` turns a text into a vector; ``reranker``, ``model`` and
    ``segment`` are optional.  ``segment`` cuts a query into words; unless given, by the words of the trade.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, catalog: DataFrame, embed: Callable[[str], list[float]], reranker=None, model: Callable[[str], str] | None = None, segment: Callable[[str], list[str]] | None = None):
        self.spark, self._chunks, self._catalog, self.store = spark, chunks, catalog, None
        self.embed, self.reranker, self.model, self.segment = embed, reranker, model, segment or segmenter()

    @classmethod
    def over(cls, store: Store, embed: Callable[[str], list[float]], **models) -> Engine:
        engine = cls(store.spark, None, None, embed, **models)
        engine.store = store
        return engine

    @property
    def chunks(self) -> DataFrame:
        return self.store.chunks() if self.store else self._chunks

    @property
    def catalog(self) -> DataFrame:
        return self.store.files() if self.store else self._catalog

    def search(self, query: str, top_k: int = 5, file_name: str | None = None, category: str | None = None) -> tuple[DataFrame, str]:
        """Citations of the best hits, and the search mode."""
        hits, mode = self._hits(query, top_k, file_name, category)
        return citations(hits), mode

    def _hits(self, query: str, top_k: int, file_name: str | None, category: str | None) -> tuple[DataFrame, str]:
        if not 1 <= top_k <= MOST:
            raise ValueError(f"top_k must be 1 to {MOST}")
        return smart_search(self.chunks, query, self.embed(query), top_k, file_name, category, self.reranker, self.segment)

    def category_of(self, query: str) -> str | None:
        """The category that the model says a question belongs to."""
        names = [r[0] for r in cat.list_categories(self.catalog).collect()]
        if len(names) < 2 or self.model is None:
            return names[0] if len(names) == 1 else None
        try:
            reply = self.model(ROUTE_PROMPT.format(categories="、".join(f'"{n}"' for n in names), query=query))
        except Exception:
            return None
        return self.spark.range(1).select(route(F.lit(reply), F.array(*map(F.lit, names))).alias("c")).first()["c"]

    def query(self, query: str, top_k: int = 5, file_name: str | None = None, category: str | None = None) -> dict:
        """An answer with citations; without hits in a category the whole corpus is searched."""
        category = category or self.category_of(query)
        hits, mode = self._hits(query, top_k, file_name, category)
        if mode.endswith("empty") and category:
            hits, mode = self._hits(query, top_k, file_name, None)
        if mode.endswith("empty"):
            return {"query": query, "answer": NO_ANSWER, "citations": [], "llm_available": False}
        text, told = answer(hits, query, self.model)
        return {"query": query, "answer": text, "citations": [r.asDict() for r in citations(hits).orderBy("id").collect()], "llm_available": told}

    def categories(self) -> DataFrame:
        return cat.list_categories(self.catalog)

    def files(self) -> DataFrame:
        return cat.list_files(self.catalog)

    def delete_file(self, file_name: str) -> None:
        """Takes the first file of a name out of the chunks and the catalog."""
        if self.store:
            return self.store.delete_name(file_name)
        found = cat.hash_by_name(self.catalog, file_name).first()
        if found is None:
            raise KeyError(file_name)
        self._chunks, self._catalog = cat.delete_by_hash(self._chunks, found[0]), cat.delete_by_hash(self._catalog, found[0])

    def reset(self) -> None:
        if self.store:
            return self.store.reset()
        self._chunks, self._catalog = self._chunks.limit(0), self._catalog.limit(0)

    def health(self) -> dict:
        """Whether the store can be read, and which engines are at hand."""
        try:
            scoped(self.chunks).limit(1).count()
            store = True
        except Exception:
            store = False
        engines = {"embedder": self.embed, "reranker": self.reranker, "model": self.model, "segmenter": self.segment}
        return {"status": "ok" if store and self.model else "degraded", "store": store, "llm": self.model is not None, "engines": {k: e is not None for k, e in engines.items()}}
