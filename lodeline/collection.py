"""A collection of vectors with string ids and JSON metadata, over a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.operators import exact, graph, ivf, kmeans, metadata, pq, sq8
from lodeline.operators.graph import HNSWConfig
from lodeline.plans.runtime import materialize, ship
from lodeline.plans.strategy import AutoTunerConfig, decide_mode, detect_ram_gb, mode_of
from lodeline.sources.store import Store

LEAST_DIM, MOST_DIM = 128, 4096
#: Vectors at most on which an index or a quantiser is trained when the collection trains it itself (all are indexed).
TRAINING_ROWS = 10_000


@dataclass(frozen=True)
class IVFConfig:
    nlist: int = 100
    nprobe: int = 10
    max_iterations: int = 20
    tolerance: float = 1e-3


class Collection:
    """``mode``: flat, hnsw, sq8 (scalar), pq (product), ivf or auto. All modes keep the full vectors; sq8, pq, hnsw and ivf add tables
    to which rows added since are appended before a search, so every row is searchable; deleted rows are left out of all of them. State is reopened from the folder.

    Scores: flat, hnsw and ivf (1 + cosine) / 2; sq8 the cosine of the decoded vector; pq the mean cosine over the
    sub-spaces. Higher is better; ties go to the row added first."""

    def __init__(self, path: str, dimension: int = 1536, mode: str = "flat", spark: SparkSession | None = None, tuner: AutoTunerConfig | None = None, quantized_graph: bool = False):
        if not LEAST_DIM <= dimension <= MOST_DIM:
            raise ValueError(f"dimension {dimension} is not within {LEAST_DIM}..{MOST_DIM}")
        self.spark = spark or SparkSession.active()
        ship(self.spark)
        self.store = Store(self.spark, path)
        self.hnsw, self.ivf = HNSWConfig(), IVFConfig()
        self.tuner = tuner or AutoTunerConfig(available_ram_gb=detect_ram_gb())
        if self.store.exists():
            m = self.store.load()
            if m["dimension"] != dimension:
                raise ValueError(f"the collection has dimension {m['dimension']}, not {dimension}")
            self.dimension = dimension
            self.hnsw, self.ivf = HNSWConfig(**m["hnsw"]), IVFConfig(**m["ivf"])
            self.mode = mode_of(mode) if mode != "flat" else m["mode"]
            self.quantized_graph = m["quantized_graph"]
        else:
            self.dimension, self.mode, self.quantized_graph = dimension, mode_of(mode), quantized_graph
            self.store.manifest = {"next_id": 0, "upto": {}}
            self.persist()

    # -- constructors -----------------------------------------------------------------------------------

    @classmethod
    def new_hnsw(cls, path: str, dimension: int = 1536, m: int = 16, ef_construction: int = 200, ef_search: int = 50, **kw) -> Collection:
        c = cls(path, dimension, "hnsw", **kw)
        c.hnsw = HNSWConfig(m, ef_construction, ef_search)
        c.persist()
        return c

    @classmethod
    def new_scalar_quantized(cls, path: str, dimension: int, training_vectors: DataFrame | Sequence, **kw) -> Collection:
        c = cls(path, dimension, "sq8", **kw)
        c.store.replace("sq8_model", sq8.train(c._rows(training_vectors), dimension))
        c.persist()
        return c

    @classmethod
    def new_product_quantized(cls, path: str, dimension: int, training_vectors: DataFrame | Sequence, **kw) -> Collection:
        c = cls(path, dimension, "pq", **kw)
        c._train_pq(c._rows(training_vectors))
        c.persist()
        return c

    @classmethod
    def new_hnsw_quantized(cls, path: str, dimension: int, training_vectors: DataFrame | Sequence, config: HNSWConfig = HNSWConfig(), **kw) -> Collection:
        """A graph that is searched over product-quantised codes."""
        c = cls(path, dimension, "hnsw", quantized_graph=True, **kw)
        c.hnsw = config
        c._train_pq(c._rows(training_vectors))
        c.persist()
        return c

    # -- rows -------------------------------------------------------------------------------------------

    def _rows(self, vectors: DataFrame | Sequence) -> DataFrame:
        """``vec_id, embedding`` of a DataFrame with an embedding column, or of lists."""
        if isinstance(vectors, DataFrame):
            d = vectors.select("embedding")
            return d.select(F.xxhash64("embedding").alias("vec_id"), "embedding")
        if not len(vectors):
            raise ValueError("training needs at least one vector")
        return self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")

    def add(self, ids: Sequence[str] | DataFrame, embeddings: Sequence | None = None, metadatas: Sequence[str] | None = None) -> int:
        """Add rows: lists, or one DataFrame ``ext_id, embedding, metadata``. All or none: wrong dimensions and ids that are repeated or
        stored raise ValueError before anything is written. Returns the number added. Metadata that is no JSON counts as {}."""
        if isinstance(ids, DataFrame):
            d = ids.select("ext_id", "embedding", "metadata")
        else:
            if not len(ids) == len(embeddings) == len(metadatas):
                raise ValueError(f"{len(ids)} ids, {len(embeddings)} embeddings and {len(metadatas)} metadatas")
            for i, v in enumerate(embeddings):
                if len(v) != self.dimension:
                    raise ValueError(f"embedding {i} has {len(v)} dimensions, expected {self.dimension}")
            d = self.spark.createDataFrame([(i, str(e), [float(x) for x in v], m) for i, (e, v, m) in enumerate(zip(ids, embeddings, metadatas))], "n bigint, ext_id string, embedding array<float>, metadata string").orderBy("n")
        # Staged once: what is checked, counted and numbered is what is written, whatever a second run of the source would give.
        d = materialize(d.select("ext_id", "embedding", "metadata", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("o")), "added")
        bad = d.where(F.col("ext_id").isNull() | F.col("embedding").isNull() | (F.size("embedding") != self.dimension)).select(F.size("embedding").alias("n")).limit(1).collect()
        if bad:
            raise ValueError(f"an embedding has {bad[0].n} dimensions, expected {self.dimension}, or a row has no id")
        if r := metadata.duplicates(d, "ext_id").limit(1).collect():
            raise ValueError(f"id {r[0][0]!r} is repeated")
        old = self._live()
        if old is not None and (r := metadata.already_stored(d, old, "ext_id").limit(1).collect()):
            raise ValueError(f"id {r[0][0]!r} is already stored")
        # Places without a global sort: the numbers that the rows were staged with within the tasks, after the sums of the tasks before.
        n, before = 0, []
        for r in d.groupBy("p").agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect():
            before.append((r.p, n))
            n += r.c
        if not n:
            return 0
        start = self.store.manifest["next_id"]
        offsets = self.spark.createDataFrame(before, "p int, first bigint")  # a row for each task of the source
        rows = d.join(F.broadcast(offsets), "p").withColumn("vec_id", F.col("first") + start + F.col("o").bitwiseAND(F.lit((1 << 33) - 1)))
        rows = rows.select("vec_id", "ext_id", "embedding", metadata.enrich("metadata", "ext_id").alias("metadata"))
        self.store.append("rows", rows)
        self.store.manifest["next_id"] = start + n
        self.store.commit()
        return n

    def set_metadata(self, ids: Sequence[str] | DataFrame, metadatas: Sequence[str] | None = None) -> int:
        """Replace the metadata of stored ids (lists, or one DataFrame ``ext_id, metadata``); of an id that comes repeatedly the greatest text counts, unknown ids are
        left out. Returns how many rows were set."""
        d = ids.select("ext_id", "metadata") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(str(i), m) for i, m in zip(ids, metadatas, strict=True)], "ext_id string, metadata string")
        if (live := self._live()) is None:
            return 0
        d = d.groupBy("ext_id").agg(F.max("metadata").alias("metadata"))
        new = materialize(live.select("vec_id", "ext_id").join(d, "ext_id").select("vec_id", metadata.enrich("metadata", "ext_id").alias("metadata")), "metadata")
        if n := new.count():
            old = self.store.read("metadata")
            self.store.replace("metadata", new if old is None else metadata.upsert(old, new, "vec_id"))
            self.store.commit()
        return n

    def metadata_count(self) -> int:
        """Rows that have metadata."""
        live = self._live()
        return live.where(F.col("metadata").isNotNull()).count() if live is not None else 0

    def _live(self) -> DataFrame | None:
        rows, changed = self._kept("rows"), self.store.read("metadata")
        if rows is None or changed is None:
            return rows
        new = changed.select("vec_id", F.col("metadata").alias("new"))
        return rows.join(new, "vec_id", "left").select("vec_id", "ext_id", "embedding", F.coalesce("new", "metadata").alias("metadata"))

    def _kept(self, table: str, key: str = "vec_id") -> DataFrame | None:
        """A table without the deleted rows."""
        rows, gone = self.store.read(table), self.store.read("deleted")
        return rows if rows is None or gone is None else metadata.delete(rows, gone.withColumnRenamed("vec_id", key), key)

    def _vectors(self) -> DataFrame:
        live = self._live()
        return live.select("vec_id", "embedding") if live is not None else self.spark.createDataFrame([], "vec_id bigint, embedding array<float>")

    def delete(self, ids: Sequence[str] | DataFrame) -> int:
        """Remove rows by id; returns how many were there. The ids may be added again."""
        d = ids.select("ext_id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(str(i),) for i in ids], "ext_id string")
        if (live := self._live()) is None:
            return 0
        hit = materialize(live.join(d, "ext_id", "left_semi").select("vec_id"), "deleted")
        n = hit.count()
        if n:
            self.store.append("deleted", hit)
            self.store.commit()
        return n

    def get(self, ext_id: str) -> str | None:
        """The metadata of an id; ValueError if it is unknown."""
        live = self._live()
        r = live.where(F.col("ext_id") == ext_id).select("metadata").limit(1).collect() if live is not None else []
        if not r:
            raise ValueError(f"unknown id {ext_id!r}")
        return r[0][0]

    def get_range(self, start: int, count: int) -> DataFrame:
        """``vec_id, embedding`` of a range of row numbers, pushed down to the scan."""
        return self._vectors().where(F.col("vec_id").between(start, start + count - 1))

    def get_codes(self, start: int, count: int, mode: str = "pq") -> DataFrame:
        """``vec_id, codes`` of a range of row numbers in mode sq8 or pq, pushed down to the scan."""
        self._ensure(mode)
        codes = self._kept(f"{mode}_codes")
        return codes.where(F.col("vec_id").between(start, start + count - 1)) if codes is not None else self.spark.createDataFrame([], "vec_id bigint, codes array<smallint>")

    def count(self) -> int:
        live = self._live()
        return live.count() if live is not None else 0

    def get_all_ids(self) -> DataFrame:
        live = self._live()
        return live.select("ext_id") if live is not None else self.spark.createDataFrame([], "ext_id string")

    # -- indexes ----------------------------------------------------------------------------------------

    def _sample(self) -> DataFrame:
        return self._vectors().orderBy("vec_id").limit(TRAINING_ROWS)

    def _train_pq(self, vectors: DataFrame) -> None:
        c = pq.train(vectors, pq.sub_spaces(self.dimension))
        self.store.replace("pq_model", pq.codebook_rows(self.spark, c))

    def train_ivf(self) -> None:
        """Fit the centroids (L2) on the first rows and put every row in its cell (cosine), partitioned by cell."""
        if self.mode != "ivf":
            raise ValueError("train_ivf needs mode ivf")
        s = self._sample()
        c = kmeans.lloyd(s, kmeans.first_vectors(s, self.ivf.nlist), self.ivf.max_iterations, self.ivf.tolerance)
        if not len(c):
            return
        self.store.replace("centroids", kmeans.centroid_rows(self.spark, c))
        self._fill_cells()
        self.store.commit()

    def _fill_cells(self) -> None:
        self.store.drop("cells")
        self.store.manifest["upto"].pop("ivf", None)
        self._ensure("ivf")

    def _ensure(self, mode: str) -> None:
        """Append to the tables that the mode searches the rows added since; train what isn't trained."""
        upto, last = self.store.manifest["upto"].get(mode, 0), self.store.manifest["next_id"]
        if upto >= last:
            return
        new = self._vectors().where(F.col("vec_id") >= upto)
        if mode == "sq8":
            model = sq8.train(self._vectors(), self.dimension) if self.store.read("sq8_model") is None else None
            if model is None and not new.isEmpty() and self.store.manifest.get("sq8_own") and self._beyond(new):
                model, new = sq8.train(self._vectors(), self.dimension), self._vectors()  # the range of all rows, so all are encoded again
                self.store.drop("sq8_codes")
            if model is not None:
                self.store.replace("sq8_model", model)
                self.store.manifest["sq8_own"] = True
            self.store.append("sq8_codes", sq8.encode(new, self.store.read("sq8_model")))
        if mode == "pq" or (mode == "hnsw" and self.quantized_graph):
            if self.store.read("pq_model") is None:
                self._train_pq(self._sample())
            since = self.store.manifest["upto"].get("pq", 0)
            self.store.append("pq_codes", pq.encode(self._vectors().where(F.col("vec_id") >= since), pq.codebook_matrix(self.store.read("pq_model"))))
            self.store.manifest["upto"]["pq"] = last
        if mode == "hnsw":
            first, shards = self.store.manifest.get("shards", 0), graph.shards_for(new.count())
            self.store.append("nodes", graph.build(new, shards, self.hnsw).withColumn("shard", (F.col("shard") + first).cast("int")))
            self.store.manifest["shards"] = first + shards
        if mode == "ivf" and self.store.read("centroids") is not None:
            cids, c = kmeans.centroid_matrix(self.store.read("centroids"))
            self.store.append("cells", ivf.with_cell(new, cids, c).repartition("cid"), "cid")
        self.store.manifest["upto"][mode] = last
        self.store.commit()

    def _beyond(self, new: DataFrame) -> bool:
        """Whether elements of the rows lie beyond the range that sq8 was trained for."""
        both = sq8.train(new, self.dimension).select("pos", F.col("mn").alias("low"), F.col("mx").alias("high")).join(self.store.read("sq8_model"), "pos")
        return not both.where("low < mn or high > mx").isEmpty()

    def effective_mode(self) -> str:
        return decide_mode(self.count(), self.tuner) if self.mode == "auto" else self.mode

    def set_mode(self, mode: str) -> None:
        self.mode = mode_of(mode)
        self.persist()

    def configure_ivf(self, nlist: int = 100, nprobe: int = 10, max_iterations: int = 10) -> None:
        self.ivf = replace(self.ivf, nlist=nlist, nprobe=nprobe, max_iterations=max_iterations)
        self.store.drop("centroids"), self.store.drop("cells")
        self.store.manifest["upto"].pop("ivf", None)
        self.persist()

    def set_ef_search(self, ef: int) -> None:
        self.hnsw = replace(self.hnsw, ef_search=ef)
        self.persist()

    def persist(self) -> None:
        self.store.manifest |= {"dimension": self.dimension, "mode": self.mode, "hnsw": asdict(self.hnsw), "ivf": asdict(self.ivf), "quantized_graph": self.quantized_graph}
        self.store.commit()

    close = persist

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # -- search -----------------------------------------------------------------------------------------

    def search_batch_df(self, queries: DataFrame | Sequence, k: int = 10) -> DataFrame:
        """``qid, rk, ext_id, score, metadata``. queries: ``qid, q``, or lists, whose numbers are the qids."""
        if not isinstance(queries, DataFrame):
            for i, v in enumerate(queries):
                if len(v) != self.dimension:
                    raise ValueError(f"query {i} has {len(v)} dimensions, expected {self.dimension}")
            queries = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "qid bigint, q array<double>")
        mode = self.effective_mode()
        live = self._live()
        if live is None:
            return self.spark.createDataFrame([], T.StructType.fromDDL("qid bigint, rk int, ext_id string, score double, metadata string"))
        self._ensure(mode)
        if mode == "sq8":
            found = sq8.search(self._kept("sq8_codes"), self.store.read("sq8_model"), queries, k)
        elif mode == "pq":
            found = pq.search(self._kept("pq_codes"), pq.codebook_matrix(self.store.read("pq_model")), queries, k)
        elif mode == "hnsw" and self.quantized_graph:
            scores = pq.table_scores(pq.codebook_matrix(self.store.read("pq_model")))
            found = graph.search(self._kept("nodes", "id"), self._kept("pq_codes").withColumnRenamed("codes", "embedding"), queries, k, self.hnsw, scores)
        elif mode == "hnsw":
            found = graph.search(self._kept("nodes", "id"), self._vectors(), queries, k, self.hnsw)
        elif mode == "ivf" and self.store.read("cells") is not None:
            cids, c = kmeans.centroid_matrix(self.store.read("centroids"))
            found = ivf.search(self._kept("cells"), cids, c, queries, k, self.ivf.nprobe)
        else:
            found = exact.batch_topk(self._vectors(), queries, k)
        return found.join(live.select("vec_id", "ext_id", "metadata"), "vec_id").select("qid", "rk", "ext_id", "score", "metadata")

    def search_batch(self, queries: Sequence, k: int = 10) -> list[list[tuple[str, float]]]:
        """(id, score) lists, in the order of the queries."""
        out: list[list[tuple[str, float]]] = [[] for _ in queries]
        for r in self.search_batch_df(queries, k).orderBy("qid", "rk").collect():
            out[r.qid].append((r.ext_id, r.score))
        return out

    def search(self, query: Sequence[float], k: int = 10) -> list[tuple[str, float]]:
        return self.search_batch([query], k)[0]

    def info(self) -> dict:
        return {"dimension": self.dimension, "mode": self.mode, "count": self.count(), "bytes": {t: self.store.bytes_of(t) for t in self.store.manifest.get("tables", {})}}

    def __repr__(self) -> str:
        return f"Collection(path={self.store.path!r}, dimension={self.dimension}, mode={self.mode!r})"
