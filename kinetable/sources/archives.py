"""Members of TAR archives, one task an archive, and reports for readers."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_files


def tar_members(spark: SparkSession, path: str, pattern: str = "*.tar", content: bool = False, broken: str = "fail") -> DataFrame:
    """Rows (archive, member, size[, data]) of the files in archives. One that is broken is an
    error, unless ``broken`` is ``skip``; then it gives the members before the break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(data)) as t:
                        for m in t:
                            if m.isfile():
                                rows.append((name.rpartition("/")[2], m.name, m.size, t.extractfile(m).read() if content else None))
                except tarfile.TarError as e:
                    if broken != "skip":
                        raise ValueError(f"{name}: {e}") from e
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["archive", "member", "size", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    out = files.select("path", "content").mapInArrow(run, "archive string, member string, size long, data binary")
    return out if content else out.drop("data")


def write_tars(df: DataFrame, folder: str) -> str:
    """Rows (archive, member, data) as one TAR file an archive."""

    def build(key, group):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, data in sorted(zip(group["member"].to_pylist(), group["data"].to_pylist(), strict=True)):
                m = tarfile.TarInfo(name)
                m.size = len(data)
                t.addfile(m, io.BytesIO(data))
        return pa.table({"path": pa.array([key[0].as_py()]), "content": pa.array([out.getvalue()], pa.binary())})

    return write_files(df.select("archive", "member", "data").groupBy("archive").applyInArrow(build, "path string, content binary"), folder)


def unpacked(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, data) of the files of one TAR archive."""
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())


def number_of_frames(members: DataFrame) -> DataFrame:
    """Frames of each archive: one more than the largest number in a member's name."""
    n = F.regexp_extract("member", "(\\d+)(?=\\.[^.]*$)", 1).try_cast("int")
    return members.groupBy("archive").agg((F.max(n) + 1).alias("n_frames"))


def text_table(rows: list[dict]) -> str:
    """Rows as a table of fixed width; for reports of a few rows."""
    if not rows:
        return ""
    names = list(rows[0])
    cells = [names, *[[f"{r[n]:.3f}" if isinstance(r[n], float) else str(r[n]) for n in names] for r in rows]]
    wide = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(c, wide, strict=True)).rstrip() for c in cells)


def html_table(df: DataFrame, limit: int = 100) -> str:
    """The first rows in order as an HTML table."""
    from html import escape

    rows = df.limit(limit).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def write_scalars(df: DataFrame, path: str) -> None:
    """Results in one JSON file, without arrays, maps and structs."""
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    df.select(*plain).coalesce(1).write.mode("overwrite").json(path)


def fixed_width(df: DataFrame) -> DataFrame:
    """Each row as one line of a table of fixed width (``line``), the widths by the longest cell
    of all rows; every row is written, by the tasks that hold it."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    wide = df.agg(*[F.max(F.length(c)) for c in cells]).first()
    width = [max(len(n), w or 0) for n, w in zip(df.columns, wide, strict=True)]
    return df.select(F.rtrim(F.concat_ws("  ", *[F.rpad(c, w, " ") for c, w in zip(cells, width, strict=True)])).alias("line"))


def latex_rows(df: DataFrame, digits: int = 1) -> DataFrame:
    """Each row as a row of a LaTeX table; numbers with so many digits."""
    kinds = dict(df.dtypes)
    cells = [F.format_number(c, digits) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in df.columns]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("row"))


def html_rows(df: DataFrame) -> DataFrame:
    """Each row as a row of an HTML table."""
    from ..functions.text import escape_html

    cells = [F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))
