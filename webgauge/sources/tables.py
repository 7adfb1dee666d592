"""The store: tables of runs as Parquet folders, their schemas, and how they are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "runs": "run_id long, start_url string, status string, started_at timestamp, finished_at timestamp, pages long, error string, settings struct<max_pages:int,max_depth:int,wall_clock_seconds:double>",
    "pages": "run_id long, seq long, url string, final_url string, status int, depth int, content_type string, bytes long, elapsed_ms int, fetched_at timestamp, html string, redirect_chain array<struct<url:string,status:int>>, headers map<string,string>, error string",
    "links": "run_id long, from_url string, to_url string",
    "sitemap_urls": "run_id long, url string",
    "issues": "run_id long, page_seq long, rule_ord int, url string, rule_id string, severity string, message string",
    "page_scores": "run_id long, url string, score int",
    "ai_cache": "key string, model string, prompt_version string, status string, suggestion struct<diagnosis:string,title:string,meta_description:string>, reason string, created_at timestamp",
    "ai_calls": "run_id long, url string, kind string, prompt_tokens int, completion_tokens int, usd double, created_at timestamp",
    "ai_suggestions": "run_id long, url string, original_title string, original_meta string, diagnosis string, title string, meta_description string, status string, reason string, cached boolean, cost_usd double",
}
#: Tables with a folder for each run, and what identifies a row.
BY_RUN = {"pages", "links", "sitemap_urls", "issues", "page_scores", "ai_calls", "ai_suggestions"}
KEYS = {"pages": ["run_id", "url"], "links": ["run_id", "from_url", "to_url"], "sitemap_urls": ["run_id", "url"], "ai_cache": ["key"], "ai_suggestions": ["run_id", "url"], "runs": ["run_id"]}


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-webgauge-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows written once in the shared folder and read back: parsed once, whatever reads them after."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Tables below a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _place(self, path: str):
        """(file system, path) of the cluster's own file API."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[table])

    def exists(self, table: str) -> bool:
        fs, at = self._place(self.path(table))
        return fs.exists(at)

    def init(self) -> None:
        """Creates what isn't there and puts back what a lost replacement left aside; repeating it changes nothing."""
        for table in SCHEMAS:
            fs, at = self._place(self.path(table))
            old = self._place(f"{self.path(table)}.old")[1]
            if not fs.exists(at) and fs.exists(old):
                fs.rename(old, at)
            if not self.exists(table):
                self.write(table, self._empty(table), "errorifexists")

    def read(self, table: str) -> DataFrame:
        """A table; reading never creates one."""
        if not self.exists(table):
            raise FileNotFoundError(f"no table {table} in {self.root}; init() creates it")
        return self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))

    def write(self, table: str, df: DataFrame, mode: str = "append") -> None:
        w = df.select(*[F.col(f.name).cast(f.dataType) for f in self._empty(table).schema]).write.mode(mode)
        if table in BY_RUN:
            w = w.partitionBy("run_id").option("partitionOverwriteMode", "dynamic")
        w.parquet(self.path(table))

    def pages(self, run_id: int, html: bool = True) -> DataFrame:
        """A run's pages; in order of fetching when ordered by seq. Without html that column isn't read."""
        p = self.read("pages").where(F.col("run_id") == run_id)
        return p if html else p.drop("html")

    def run(self, run_id: int) -> DataFrame:
        return self.read("runs").where(F.col("run_id") == run_id).limit(1)

    def insert_ignore(self, table: str, rows: DataFrame) -> None:
        """Rows whose key isn't there yet; of new rows that share one, any."""
        keys = KEYS[table]
        self.write(table, rows.dropDuplicates(keys).join(self.read(table).select(*keys), keys, "left_anti"))

    def replace_runs(self, table: str, rows: DataFrame) -> None:
        """All rows of the runs that occur in rows, atomically for each run's folder."""
        self.write(table, rows, "overwrite")

    def issues(self, run_id: int) -> DataFrame:
        """A run's issues, page by page in order of fetching, within a page in the order of the rules."""
        return self.read("issues").where(F.col("run_id") == run_id).orderBy("page_seq", "rule_ord")

    def suggestions(self, run_id: int) -> DataFrame:
        """A run's suggestions by address."""
        return self.read("ai_suggestions").where(F.col("run_id") == run_id).orderBy("url")

    def upsert(self, table: str, rows: DataFrame) -> None:
        """The given rows win over those with the same key (of given rows that share one, any). For tables without run folders."""
        keys = KEYS[table]
        given = rows.dropDuplicates(keys)
        self._replace(table, self.read(table).join(given.select(*keys), keys, "left_anti").unionByName(given, allowMissingColumns=True))

    def _replace(self, table: str, rows: DataFrame) -> None:
        """The whole table, written beside and then put in place: a job that is lost leaves the old table, here or under ``.old``."""
        if table in BY_RUN:
            raise ValueError(f"{table} is replaced run by run")
        path = self.path(table)
        beside, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self._empty(table).schema]).write.parquet(beside)
        fs, at = self._place(path)
        fs.delete(self._place(old)[1], True)
        if not (fs.rename(at, self._place(old)[1]) and fs.rename(self._place(beside)[1], at)):
            raise OSError(f"{table} could not be put in place; the new rows are in {beside}, the old ones in {old} or {path}")

    def delete_run(self, run_id: int) -> None:
        """A run with all that belongs to it; the cache of suggestions stays, as it belongs to contents. A missing run is no error."""
        for table in sorted(BY_RUN):
            fs, at = self._place(f"{self.path(table)}/run_id={run_id}")
            fs.delete(at, True)
        self._replace("runs", self.read("runs").where(F.col("run_id") != run_id))

    def new_run(self, start_url: str, settings: dict) -> int:
        run_id = (self.read("runs").agg(F.max("run_id")).first()[0] or 0) + 1
        row = [(run_id, start_url, "running", None, None, 0, None, (settings.get("max_pages"), settings.get("max_depth"), settings.get("wall_clock_seconds")))]
        df = self.spark.createDataFrame(row, SCHEMAS["runs"]).withColumn("started_at", F.date_trunc("second", F.current_timestamp()))
        self.write("runs", df)
        return run_id

    def finish_run(self, run_id: int, status: str, pages: int, error: str | None = None) -> None:
        at = F.date_trunc("second", F.current_timestamp())
        self.upsert("runs", self.run(run_id).withColumns({"status": F.lit(status), "pages": F.lit(pages).cast("long"), "error": F.lit(error).cast("string"), "finished_at": at}))

    def reconcile(self, seconds: float) -> int:
        """Runs that are marked as running past their time become partial; how many."""
        from webgauge.operators.views import stale

        late = stored(self.read("runs").where(stale(F.current_timestamp(), seconds)), "late")
        n = late.count()
        if n:
            self.upsert("runs", late.withColumns({"status": F.lit("partial"), "error": F.lit("interrupted"), "finished_at": F.date_trunc("second", F.current_timestamp())}))
        return n
