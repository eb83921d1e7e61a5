"""Repository files as tables: scan, ignore rules, guards, byte budget, frameworks, chunks (SRC1-3, SRC13, AGG4, AGG10, PRJ10-14, WIN8, FLT5)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.schemas import CHUNK_KINDS
from codequarry.shipping import ship
from codequarry.tables import new_path

# Folders that are never read; any folder that starts with a dot is left out, too (fixed values).
IGNORED = [".git", "node_modules", ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".next", "dist", "build", "out", ".idea", ".vscode", ".coverage", "htmlcov", ".turbo", ".cache"]

# Package -> framework (fixed values).
PYTHON_FRAMEWORKS = {"fastapi": "FastAPI", "flask": "Flask", "django": "Django", "sqlalchemy": "SQLAlchemy", "pydantic": "Pydantic", "alembic": "Alembic", "uvicorn": "Uvicorn", "pytest": "Pytest", "celery": "Celery", "langchain": "LangChain", "langgraph": "LangGraph", "httpx": "HTTPX", "requests": "Requests", "torch": "PyTorch", "tensorflow": "TensorFlow"}
JS_FRAMEWORKS = {"next": "Next.js", "react": "React", "vue": "Vue.js", "svelte": "Svelte", "express": "Express", "fastify": "Fastify", "nest": "NestJS", "@nestjs/core": "NestJS", "axios": "Axios", "tailwindcss": "TailwindCSS", "prisma": "Prisma", "typeorm": "TypeORM", "jest": "Jest", "vitest": "Vitest"}


def ignored(path: Column) -> Column:
    """SRC2: whether a folder of the path is left out."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda d: d.isin(IGNORED) | d.startswith("."))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """SRC1, SRC3: path (relative), size_bytes, is_binary, content of every file that isn't ignored; undecodable bytes are dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    path = F.expr("substring_index(path, ':', -1)")
    rel = F.regexp_replace(F.substring(F.regexp_replace(path, "^/+", "/"), len(root) + 1, 1 << 20), "^/+", "")
    binary = F.position(F.lit(b"\x00"), F.col("content")) > 0
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return raw.select(rel.alias("path"), F.col("length").alias("size_bytes"), binary.alias("is_binary"), F.when(~binary, text).alias("content")).where(~ignored(F.col("path")))


def manifest(files: DataFrame, max_files: int | None = 5000, max_file_bytes: int = 1 << 20, max_bytes: int = 50 << 20, partition: str | None = None) -> DataFrame:
    """AGG10, FLT7: path, language, size_bytes, lines_count, skipped_reason of the first max_files files by path, or of all (None).

    The byte budget is greedy: a file that doesn't fit is skipped and later smaller ones may still fit, so it is an ordered
    fold and no running sum. Files over the size limit or binary take nothing of it. A repository is one group of
    max_files rows at most; with a partition column each repository is folded by itself. Without max_files a repository
    may be of any size: it is folded in ordered pieces (folded_by_pieces).
    """
    keys = [partition] if partition else []
    if max_files is None:
        return listed(folded_by_pieces(files, keys, max_file_bytes, max_bytes), keys)
    ranked = files.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("path"))).where(F.col("__n") <= max_files)

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("path", "ascending"), ("size_bytes", "ascending"), ("is_binary", "ascending")])
        used, reasons = 0, []
        for size, binary in zip(table.column("size_bytes").to_pylist(), table.column("is_binary").to_pylist(), strict=True):
            why = "byte budget exceeded" if used + size > max_bytes else "file too large" if size > max_file_bytes else "binary" if binary else None
            used += 0 if why else size
            reasons.append(why)
        return table.append_column("skipped_reason", pa.array(reasons, pa.string()))

    ship(files.sparkSession)
    kind = lambda c: dict(files.dtypes)[c]
    shape = ", ".join(f"{c} {kind(c)}" for c in (*keys, "path", "size_bytes", "is_binary"))
    reasons = ranked.select(*keys, "path", "size_bytes", "is_binary").groupBy(*keys).applyInArrow(fold, f"{shape}, skipped_reason string").select(*keys, "path", "skipped_reason")
    return listed(ranked.join(reasons, [*keys, "path"]), keys)


def listed(out: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of a manifest from files with their skipped_reason."""
    return out.select(*keys, "path", X.language(F.col("path")).alias("language"), "size_bytes", F.when(F.col("skipped_reason").isNull(), X.line_count(F.coalesce("content", F.lit("")))).alias("lines_count"), "is_binary", "skipped_reason", "content")


def folded_by_pieces(files: DataFrame, keys: list[str], max_file_bytes: int, max_bytes: int, piece_rows: int = 250_000) -> DataFrame:
    """files with skipped_reason, by the fold of manifest over all rows of a repository, in order of path, size and is_binary.

    All rows are sorted into ranges (pieces). A piece that fits whole into what is left of the budget, or of which nothing
    fits, hands the used bytes on by its sum and smallest size; any other is walked, a job for the next such piece of all
    repositories at once. Then all pieces are walked side by side. The driver sees only repositories that span pieces:
    two rows a piece at most.
    """
    spark = files.sparkSession
    ship(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count() // piece_rows + 1)
    order = [*keys, "path", "size_bytes", "is_binary"]
    path = new_path(spark, "manifest")
    files.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    size, binary = F.col("size_bytes").cast("long"), F.coalesce("is_binary", F.lit(False))
    light = rows.select(F.shiftright("__at", 33).alias("piece"), F.col("__at").alias("at"), key.alias("key"), size.alias("size"), binary.alias("binary"))
    takes = ~F.col("binary") & F.coalesce(F.col("size") <= max_file_bytes, F.lit(True))
    sums = light.groupBy("key", "piece").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.coalesce(F.sum(F.when(takes, F.col("size"))), F.lit(0)).alias("total"), F.min(F.when(takes & (F.col("size") > 0), F.col("size"))).alias("least"),
        F.max(takes & (F.col("size").isNull() | (F.col("size") < 0))).alias("odd"))
    spans = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "first", "last", "total", "least", "odd"))).alias("pieces")).where(F.size("pieces") > 1).collect()

    def walk(some: DataFrame, start: dict[int, int | None]) -> DataFrame:
        """at, reason, used after each row; start: bytes used before the row where a repository goes on."""

        def fold(table: pa.Table) -> pa.Table:
            table = table.sort_by("at")
            reasons, after, last, used = [], [], None, 0
            for at, k, size, binary in zip(*(table.column(c).to_pylist() for c in ("at", "key", "size", "binary")), strict=True):
                if k != last:
                    last, used = k, start.get(at, 0)
                known = size is not None
                if known and used is not None and used + size > max_bytes:
                    why = "byte budget exceeded"
                else:
                    why = "file too large" if known and size > max_file_bytes else "binary" if binary else None
                    if why is None:  # an unknown size leaves the used bytes unknown
                        used = used + size if known and used is not None else None
                reasons.append(why)
                after.append(used)
            return pa.table({"at": table.column("at"), "reason": pa.array(reasons, pa.string()), "used": pa.array(after, pa.int64())})

        return some.groupBy("piece").applyInArrow(fold, "at long, reason string, used long")

    start: dict[int, int | None] = {}
    going: list[tuple[Iterator, int | None]] = [(iter(r["pieces"]), 0) for r in spans]
    while going:
        stopped = []
        for pieces, used in going:
            for x in pieces:
                start[x["first"]] = used
                if used is None or (not x["odd"] and (x["least"] is None or used + x["least"] > max_bytes)):
                    continue
                if x["odd"] or used + x["total"] > max_bytes:
                    stopped.append((pieces, x))
                    break
                used += x["total"]
        if not stopped:
            break
        ends = walk(light.where(F.col("piece").isin([x["piece"] for _, x in stopped])), {x["first"]: start[x["first"]] for _, x in stopped}).where(F.col("at").isin([x["last"] for _, x in stopped]))
        after = {r["at"]: r["used"] for r in ends.select("at", "used").collect()}
        going = [(pieces, after[x["last"]]) for pieces, x in stopped]
    reasons = walk(light, start).select(F.col("at").alias("__at"), F.col("reason").alias("skipped_reason"))
    return rows.join(reasons, "__at")


#: Why a file isn't read, as a stored manifest says it, for the reasons of manifest() (fixed values).
SKIPPED = {"byte budget exceeded": "total_source_byte_budget_exceeded", "file too large": "exceeds_max_size", "binary": "binary_file"}


def manifests(files: DataFrame, max_files: int = 5000, max_file_bytes: int = 1 << 20, max_bytes: int = 50 << 20) -> tuple[DataFrame, DataFrame]:
    """SRC1, FLT7, AGG4, AGG10 for many repositories: the files of each, and its totals.

    files: repo, path, size_bytes, is_binary, content. Files: those of manifest(), with skipped_reason as SKIPPED says. Totals: repo, truncated, reason, files_processed,
    source_bytes_processed, total_observed_files, total_observed_bytes, languages. In order of path, files are observed until one is beyond max_files: that one is
    still counted, and its limit is then the reason; else the byte budget is, if a file didn't fit. Languages count the files observed within the limit, read or not.
    """
    names = F.create_map(*[F.lit(x) for kv in SKIPPED.items() for x in kv])
    entries = manifest(files, max_files, max_file_bytes, max_bytes, "repo").withColumn("skipped_reason", names[F.col("skipped_reason")])
    w = Window.partitionBy("repo").orderBy("path")
    seen = files.select("repo", "path", "size_bytes").withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_files + 1)
    observed = seen.groupBy("repo").agg(F.count("*").alias("total_observed_files"), F.sum("size_bytes").alias("total_observed_bytes"))
    read = F.col("skipped_reason").isNull()
    sums = entries.groupBy("repo").agg(F.count_if(read).alias("files_processed"), F.sum(F.when(read, F.col("size_bytes")).otherwise(0)).alias("source_bytes_processed"), F.bool_or(F.coalesce(F.col("skipped_reason") == SKIPPED["byte budget exceeded"], F.lit(False))).alias("over_bytes"))
    per = entries.where("language is not null").groupBy("repo", "language").agg(F.count("*").alias("n")).groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
    over = F.col("total_observed_files") > max_files
    reason = F.when(over, f"exceeded_max_repo_files ({max_files})").when(F.col("over_bytes"), f"exceeded_max_total_source_bytes ({max_bytes} bytes)")
    totals = observed.join(sums, "repo").join(per, "repo", "left").select("repo", (over | F.col("over_bytes")).alias("truncated"), reason.alias("reason"), "files_processed", "source_bytes_processed", "total_observed_files", "total_observed_bytes", F.coalesce("languages", F.create_map().cast("map<string,bigint>")).alias("languages"))
    return entries, totals


def language_counts(files: DataFrame, max_files: int | None = 5000) -> DataFrame:
    """AGG4: files by language before the guards, among the first max_files by path, or all (None)."""
    some = files if max_files is None else files.orderBy("path").limit(max_files)
    return some.groupBy(X.language(F.col("path")).alias("language")).agg(F.count("*").alias("n")).where("language is not null")


def frameworks(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """SRC13, JSN3, WIN8: keys, name, version, evidence of the frameworks that the manifests in the root declare, first seen first."""
    keys = keys or []
    js = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("name"), F.lit(i).alias("i")) for i, (k, v) in enumerate(JS_FRAMEWORKS.items())])
    py = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("name"), F.lit(i).alias("i")) for i, (k, v) in enumerate(PYTHON_FRAMEWORKS.items())])
    dep = "map<string,string>"
    parsed = files.where("path = 'package.json'").select(*keys, F.from_json("content", f"struct<dependencies: {dep}, devDependencies: {dep}>").alias("j"))
    maps = [F.coalesce(F.map_entries(F.col(f"j.{c}")), F.array().cast("array<struct<key:string,value:string>>")) for c in ("dependencies", "devDependencies")]
    a = parsed.select(*keys, F.posexplode(F.concat(*maps)).alias("pos", "d")).select(*keys, "pos", "d.*", F.explode(js).alias("s")).where(F.lower("key").contains(F.col("s.k")))
    a = a.select(*keys, F.lit(1).alias("prio"), "pos", "s.i", "s.name", F.col("value").alias("version"), F.concat(F.lit("Declared '"), "key", F.lit("' in package.json")).alias("evidence"))
    lines = files.where("path = 'requirements.txt'").select(*keys, F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    name, version = X.requirement(F.col("line"))
    b = lines.select(*keys, "pos", "line", name.alias("pkg"), version.alias("version"), F.explode(py).alias("s")).where("pkg = s.k").select(*keys, F.lit(2).alias("prio"), "pos", "s.i", "s.name", "version", F.concat(F.lit("Declared '"), "line", F.lit("' in requirements.txt")).alias("evidence"))
    c = files.where("path = 'pyproject.toml'").select(*keys, "content", F.explode(py).alias("s")).where(F.lower("content").contains(F.col("s.k")))
    c = c.select(*keys, F.lit(3).alias("prio"), F.lit(0).alias("pos"), "s.i", "s.name", F.lit(None).cast("string").alias("version"), F.concat(F.lit("Referenced '"), "s.k", F.lit("' in pyproject.toml")).alias("evidence"))
    w = Window.partitionBy(*keys, "name").orderBy("prio", "pos", "i")
    return a.unionByName(b).unionByName(c).withColumn("n", F.row_number().over(w)).where("n = 1").select(*keys, "name", "version", "evidence")


def chunks(files: DataFrame, symbols: DataFrame, commit: str | Column, most_lines: int = 500, keys: list[str] | None = None) -> DataFrame:
    """PRJ10-13: keys, and a chunk per function, class, method and route; of a file without any, one of its first lines. Blank ones are left out. commit: one for all, or a
    column of files, each repository's own; keys name the repository."""
    keys = keys or []
    files = files.withColumn("commit_sha", commit if isinstance(commit, Column) else F.lit(commit))
    kind = F.create_map(*[F.lit(x) for kv in CHUNK_KINDS.items() for x in kv])[F.col("kind")]
    own = symbols.withColumn("symbol_kind", kind).where("symbol_kind is not null").select(*keys, "path", F.col("name").alias("symbol"), "symbol_kind", "start_line", "end_line")
    met = own.join(files.select(*keys, "path", "commit_sha", "language", "content"), [*keys, "path"]).where("content is not null")
    whole = files.where("content is not null").join(own, [*keys, "path"], "left_anti").select(*keys, "path", X.base_name(F.col("path")).alias("symbol"), F.lit("FILE").alias("symbol_kind"), F.lit(1).alias("start_line"), F.least(F.lit(most_lines), F.greatest(F.lit(1), X.line_count(F.col("content")))).alias("end_line"), "commit_sha", "language", "content")
    body = X.line_slice(F.col("content"), F.col("start_line"), F.col("end_line"))
    out = met.unionByName(whole).withColumn("content", body).where(F.trim("content") != "")
    ident = F.concat_ws(":", F.left("commit_sha", F.lit(12)), "path", "symbol", F.col("start_line").cast("string"))
    return out.select(*keys, ident.alias("chunk_id"), "commit_sha", F.col("path").alias("file_path"), "language", "symbol", "symbol_kind", "start_line", "end_line", "content", X.sha256(F.col("content")).alias("content_hash"))


def grep(files: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """FLT5: path, line_number, line of the first lines that show a text in any case; 100 at most."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    return lines.where(F.lower("line").contains(text.lower())).select("path", (F.col("i") + 1).alias("line_number"), "line").orderBy("path", "line_number").limit(min(limit, 100))


def confined(path: Column) -> Column:
    """FLT11: whether a relative path stays inside its root, read as text alone."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    depth = F.aggregate(F.split(p, "/"), F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda a, s: F.struct(
        F.when(s.isin("", "."), a["d"]).when(s == "..", a["d"] - 1).otherwise(a["d"] + 1).alias("d"), (a["ok"] & ~((s == "..") & (a["d"] <= 0))).alias("ok")))
    return (F.trim(p) != "") & ~p.startswith("/") & ~p.rlike("^[a-zA-Z]:") & depth["ok"]
