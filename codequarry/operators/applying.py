"""Strict application of unified diffs to repository files, many patches of many repositories at once (SNK9).

A diff is read in one small pass per patch; what it says of a file meets that file's content once, in a join on repository and path.
A patch is applied whole or not at all: its first error, in the order of its files, stands for all of them.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.shipping import ship

# Suffixes of files that no diff may touch (fixed values).
BINARY_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".exe", ".dll", ".so", ".dylib", ".bin", ".pyc",
    ".db", ".sqlite", ".sqlite3", ".zip", ".tar", ".gz", ".pdf", ".wasm", ".class", ".o", ".a",
]

_HEAD = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_OLD, _NEW = re.compile(r"^--- (?:a/)?(\S+)"), re.compile(r"^\+\+\+ (?:b/)?(\S+)")
_SECTION = "file_idx int, path string, creates boolean, deletes boolean, hunks array<struct<at: int, lines: array<string>>>"


class Refused(ValueError):
    """A diff that may not be applied; the message is the reason."""


def _hunks(lines: list[str]) -> list[dict]:
    """Hunks of a file's lines, in order of where they stand; each line keeps its mark."""
    found: list[tuple[tuple[int, int, int, int], list[str]]] = []
    for line in lines:
        if m := _HEAD.match(line):
            found.append((tuple(1 if g is None else int(g) for g in m.groups()), []))
        elif found and line[:1] in (" ", "+", "-"):
            found[-1][1].append(line)
        elif found and not line.strip():
            found[-1][1].append(" ")  # an empty line is one of context
        elif found and not line.startswith("\\"):
            raise Refused("invalid line marker")
    for (_, old, _, new), body in found:
        if sum(x[0] != "+" for x in body) != old or sum(x[0] != "-" for x in body) != new:
            raise Refused("count mismatch")
    found.sort(key=lambda h: h[0][0])
    for (a, _), (b, _) in zip(found, found[1:], strict=False):
        if a[0] + a[1] > b[0]:
            raise Refused("overlapping hunks")
    return [{"at": max(0, h[0] - 1), "lines": body} for h, body in found]


def read_diff(diff: str | None) -> list[tuple]:
    """A diff's files as (path, creates, deletes, hunks), or Refused. Blank lines around a file's section don't count."""
    text = (diff or "").strip()
    if not text:
        raise Refused("empty diff")
    if "GIT binary patch" in text or "Binary files " in text:
        raise Refused("binary patch")
    out = []
    for section in re.split(r"^(?=--- \S)", text, flags=re.M):
        if not section.strip():
            continue
        lines = section.strip().splitlines()
        old, new = _OLD.match(lines[0]), _NEW.match(lines[1]) if len(lines) > 1 else None
        if not old or not new:
            raise Refused("malformed file headers")
        was, now = old[1].replace("\\", "/"), new[1].replace("\\", "/")
        creates, deletes = was.startswith("/dev/null"), now.startswith("/dev/null")
        path = (was if deletes else now).lstrip("/")
        if posixpath.splitext(path.lower())[1] in BINARY_SUFFIXES:
            raise Refused("binary file")
        hunks = _hunks(lines[2:])
        if not hunks and not deletes:
            raise Refused("no hunks")
        out.append((path, creates, deletes, hunks))
    return out


def sections(patches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, patch_id, file_idx, path, creates, deletes, hunks, error: a row per file of a diff; a refused diff is one row with its error alone."""
    ship(patches.sparkSession)
    rows = patches.select(*keys, "patch_id", "unified_diff")
    kept = [*keys, "patch_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for *key, diff in b.itertuples(index=False):
                try:
                    out += [(*key, i, *x, None) for i, x in enumerate(read_diff(diff))]
                except Refused as e:
                    out.append((*key, 0, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[*kept, "file_idx", "path", "creates", "deletes", "hunks", "error"])

    shape = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in kept)
    return rows.mapInPandas(run, f"{shape}, {_SECTION}, error string")


def _file_lines(content: str) -> list[str]:
    """Lines without their ends: \\n, \\r\\n or \\r."""
    lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def patched(content: str | None, exists: bool, creates: bool, deletes: bool, hunks: list[dict]) -> str:
    """A file's content after one section of a diff ('' if deleted), or Refused. Lines must stand where the hunks say; a text ends in \\n."""
    if creates and exists:
        raise Refused("file already exists")
    if not creates and not exists:
        raise Refused("file not found")
    if not creates and content is None:
        raise Refused("not a text file")
    source, out, at = [] if creates else _file_lines(content or ""), [], 0
    for h in hunks:
        if h["at"] < at:
            raise Refused("overlapping hunks")
        out += source[at : h["at"]]
        at = h["at"]
        for line in h["lines"]:
            if line[0] == "+":
                if deletes:
                    raise Refused("deletion adds lines")
                out.append(line[1:])
            elif at >= len(source) or source[at] != line[1:]:
                raise Refused("context mismatch")
            else:
                out += [source[at]] if line[0] == " " else []
                at += 1
    out += source[at:]
    return "" if deletes else "".join(x + "\n" for x in out)


def confined(path: str) -> str | None:
    """The path in its plain form; null if it leaves the repository or names none."""
    p = path.replace("\\", "/").strip()
    plain = posixpath.normpath(p) if p else ".."
    return None if p.startswith("/") or p[1:2] == ":" or plain == ".." or plain.startswith("../") else plain


def apply_patches(patches: DataFrame, files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, patch_id, path, content, deleted, error: a row per file that a patch touches; of a patch with an error, its rows hold that and no content.

    patches: keys, patch_id, unified_diff. files: keys, path, content (null: not a text). keys name the repository; the same path in two is two files.
    A patch may list a file more than once: its sections follow each other. A diff that can't be read is one row without a path. Reasons are own
    words. Contents are joined once for each file of a patch.
    """
    keys = ["repo"] if keys is None else keys
    ship(patches.sparkSession)
    plain = F.pandas_udf(lambda s: s.map(confined, na_action="ignore"), "string")
    parts = sections(patches, keys)
    unread = parts.where("error is not null").select(*keys, "patch_id", F.lit(0).alias("at"), "path", F.lit(None).cast("string").alias("content"), F.lit(False).alias("deleted"), "error")
    good = parts.where("error is null").withColumn("target", plain("path"))
    steps = F.array_sort(F.collect_list(F.struct("file_idx", "path", "creates", "deletes", "hunks")))
    by_file = good.groupBy(*keys, "patch_id", F.coalesce("target", "path").alias("path")).agg(steps.alias("steps"), F.bool_or(F.col("target").isNull()).alias("outside"))
    there = files.select(*keys, "path", F.col("content").alias("original"), F.lit(True).alias("there"))
    met = by_file.join(there, [*keys, "path"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    names = [*keys, "patch_id", "at", "path", "content", "deleted", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for *key, path, steps, outside, original, there in b[[*keys, "patch_id", "path", "steps", "outside", "original", "there"]].itertuples(index=False):
                content, exists, error, at = original if isinstance(original, str) else None, bool(there), None, int(steps[0]["file_idx"])
                try:
                    if outside:
                        raise Refused("path leaves the repository")
                    for s in steps:
                        at = int(s["file_idx"])
                        content = patched(content, exists, bool(s["creates"]), bool(s["deletes"]), s["hunks"])
                        exists = not s["deletes"]
                except Refused as e:
                    content, error = None, str(e)
                out.append((*key, at, path, content, not exists and error is None, error))
            yield pd.DataFrame(out, columns=names)

    shape = ", ".join(f"{c} {dict(patches.dtypes)[c]}" for c in (*keys, "patch_id"))
    done = met.mapInPandas(run, f"{shape}, at int, path string, content string, deleted boolean, error string")
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("at", "error"))).over(Window.partitionBy(*keys, "patch_id"))["error"]
    whole = done.withColumn("first", first)
    whole = whole.select(*keys, "patch_id", "path", F.when(F.col("first").isNull(), F.col("content")).alias("content"), (F.col("deleted") & F.col("first").isNull()).alias("deleted"), F.col("first").alias("error"))
    return whole.unionByName(unread.drop("at"))
