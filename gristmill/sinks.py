"""Flat files and reports of results."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import typed
from .sources.grid import _exactly

#: Fields that identify a record rather than describe it; reports list them last.
IDENTIFIERS = frozenset({"study_name", "sample_id", "subject_id", "pmid", "curator", "ncbi_accession", "host_species", "uncurated_metadata"})
PROVENANCE = (("evidence_quote", "evidence"), ("section", "section"), ("confidence", "confidence"))


def cell_text(c: Column, variant: bool = False) -> Column:
    """A value as a CSV cell: null is '', and the list of a variant is joined by `; `."""
    return typed.cell(c) if variant else F.coalesce(c.cast("string"), F.lit(""))


def _keys(df: DataFrame, bag: str) -> list[str]:
    """Keys of all maps, sorted; a schema-sized list for the driver."""
    return [r.k for r in df.select(F.explode(F.map_keys(bag)).alias("k")).distinct().orderBy("k").collect()]


def sample_rows(samples: DataFrame, bag: str = "values", columns: list[str] | None = None) -> DataFrame:
    """A row a sample: paper_id, then the sorted union of keys; what a sample lacks is ''."""
    names = [c for c in (columns if columns is not None else _keys(samples, bag)) if c != "paper_id"]
    variant = typed.holds_variants(samples, bag)
    return samples.select("paper_id", *[cell_text(F.try_element_at(bag, F.lit(c)), variant).alias(c) for c in names])


def study_rows(fields: DataFrame, names: list[str], provenance: bool = False) -> DataFrame:
    """A row a paper with the fields' values; with provenance also evidence, section and confidence of each."""
    aggregates, value = [], cell_text(F.col("value"), typed.holds_variants(fields, "value"))
    for name in names:
        here = F.col("field") == name
        aggregates.append(cell_text(F.max(F.when(here, value))).alias(name))
        if provenance:
            aggregates += [cell_text(F.max(F.when(here, F.col(source)))).alias(f"{name}__{suffix}") for source, suffix in PROVENANCE]
    return fields.groupBy("paper_id").agg(*aggregates)


def subgroup_rows(papers: DataFrame, fields: DataFrame, names: list[str], provenance: bool = False) -> DataFrame:
    """A row a subgroup: its own value of a field where there is one, else the study's.  A paper without subgroups has no row."""
    packed = fields.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct(*[c for c in fields.columns if c not in ("paper_id", "field")])))).alias("f"))
    rows = papers.select("paper_id", F.explode("subgroups").alias("subgroup")).join(packed, "paper_id", "left")
    out, variant = [], typed.holds_variants(fields, "value")
    for name in names:
        item = F.try_element_at("f", F.lit(name))
        has = F.coalesce(F.map_contains_key(item["by_subgroup"], F.col("subgroup")), F.lit(False))
        out.append(cell_text(F.when(has, F.try_element_at(item["by_subgroup"], F.col("subgroup"))).otherwise(item["value"]), variant).alias(name))
        if provenance:
            out += [cell_text(item[source]).alias(f"{name}__{suffix}") for source, suffix in PROVENANCE]
    return rows.select("paper_id", "subgroup", *out)


# ------------------------------------------------------------- one file a name


def csv_line(cells: list[Column], sep: str = ",") -> Column:
    """Text cells as a line; those with a separator, a quote or a line end are quoted, null is ''."""

    def quoted(c: Column) -> Column:
        return F.when(c.rlike(f'[{sep}"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    line = F.concat_ws(sep, *[quoted(F.coalesce(c.cast("string"), F.lit(""))) for c in cells])
    return F.when(line == "", '""').otherwise(line) if len(cells) == 1 else line


def write_named(lines: DataFrame, folder: str, line_end: str = "\r\n") -> int:
    """Writes lines (name, at, line) as one file for each name, in the order of `at`; returns the number of files.

    A task streams a file's lines, sorted, to a staging folder.  Only when all
    are there are they renamed, each to its exact name, replacing what has it;
    a failed job leaves the folder as it was.  Equal input gives equal bytes if
    `at` tells the lines of a name apart.  Files of a file: folder are opened and
    renamed by the tasks; in any other store Spark's writer makes them, a folder
    each, and the driver renames them one by one.
    """
    spark = lines.sparkSession
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    system = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staging = jvm.org.apache.hadoop.fs.Path(base, f"_staging-{uuid.uuid4().hex}")
    at = system.makeQualified(base).toUri()
    try:
        if at.getScheme() == "file":
            return _named_by_tasks(lines, os.fsencode(at.getPath()), staging.getName(), staging.toString(), line_end)
        return _named_by_driver(lines, base, system, staging, line_end)
    finally:
        system.delete(staging, True)


def _named_by_tasks(lines: DataFrame, base: bytes, staging: str, url: str, line_end: str) -> int:
    """Files of a folder that tasks can open.  `url` is the staging folder as Spark names it."""
    end, top = line_end.encode(), os.path.join(base, staging.encode())

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex
        own, most, made, out, current = os.path.join(top, attempt.encode()), 0, [], None, None
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        try:
            for name, line in rows:
                if out is None or name != current:
                    if out:
                        out.close()
                    else:
                        os.makedirs(own)
                        most = os.pathconf(own, "PC_NAME_MAX")
                    current, out = name, open(os.path.join(own, b"%d" % len(made)), "wb")
                    fits = name not in (None, b"", b".", b"..") and b"/" not in name and b"\0" not in name and len(name) <= most
                    made.append((name, f"{attempt}/{len(made)}", str(os.fstat(out.fileno()).st_ino), fits))
                out.write((line or b"") + end)
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made) if made else [[]] * 4, (pa.binary(), pa.string(), pa.string(), pa.bool_()))], ["name", "part", "inode", "fits"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for name, part, inode in (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3)))):
            target = os.path.join(base, name)
            with contextlib.suppress(OSError):  # of the file that had the name
                os.unlink(os.path.join(base, b"." + name + b".crc"))
            try:
                os.replace(os.path.join(top, part.encode()), target)
            except FileNotFoundError:  # an earlier attempt of this task has placed it
                if str(os.stat(target).st_ino) != inode:
                    raise
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    schema = "name binary, part string, inode string, fits boolean"
    keyed = lines.select(F.encode("name", "UTF-8").alias("name"), "at", F.col("line").cast("string").cast("binary").alias("line"))
    spark = lines.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # a given number stays, though the bytes be few
    keyed.repartition(n, "name").sortWithinPartitions("name", "at").select("name", "line").mapInArrow(stage, schema).write.parquet(f"{url}/names")
    names = spark.read.schema(schema).parquet(_exactly(f"{url}/names"))
    wrong = names.where("NOT fits").select("name").first()
    if wrong:
        raise ValueError(f"no single file can have the name {None if wrong.name is None else bytes(wrong.name).decode('utf-8', 'replace')!r}")
    return names.select("name", "part", "inode").mapInArrow(place, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _named_by_driver(lines: DataFrame, base, system, staging, line_end: str) -> int:
    """Files of a store that Spark reaches and tasks' own code may not."""
    path = lines.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    keyed = lines.select(F.lower(F.hex(F.encode("name", "UTF-8"))).alias("key"), "at", "line")
    sorted_lines = keyed.repartition("key").sortWithinPartitions("key", "at").select("key", "line")
    sorted_lines.write.partitionBy("key").option("lineSep", line_end).text(staging.toString())
    made = [(bytes.fromhex(d.getPath().getName()[4:]).decode(), f.getPath()) for d in system.listStatus(staging) if d.isDirectory() for f in system.listStatus(d.getPath()) if f.getPath().getName().startswith("part-")]
    wrong = [name for name, _ in made if not name or "/" in name] or [name for name, n in Counter(name for name, _ in made).items() if n > 1]
    if wrong:
        raise ValueError(f"no single file can have the name {wrong[0]!r}")
    for name, part in made:
        target = path(base, path(None, None, f"./{name}"))
        system.delete(target, False)
        if not system.rename(part, target):
            raise OSError(f"{part} could not be renamed to {target}")
    return len(made)


def _with_header(name: Column, header: Column, rows: DataFrame, papers: DataFrame) -> DataFrame:
    """Lines (name, at, line) of `rows` (paper_id, at, line) under a header for each of `papers`."""
    heads = papers.select(name.alias("name"), F.lit(None).cast("long").alias("at"), header.alias("line"))
    return heads.unionByName(rows.select(name.alias("name"), F.col("at").cast("long").alias("at"), "line"))


def write_table_files(rows: DataFrame, folder: str, order: str, suffix: str = ".csv", sep: str = ",", papers: DataFrame | None = None) -> int:
    """A file for each paper_id of `rows`, with all columns but `order`; of `papers` also those without a row, which get the header alone."""
    columns = [c for c in rows.columns if c != order]
    body = rows.select("paper_id", F.col(order).alias("at"), csv_line([F.col(c) for c in columns], sep).alias("line"))
    listed = (rows if papers is None else papers).select("paper_id").distinct()
    return write_named(_with_header(F.concat("paper_id", F.lit(suffix)), csv_line([F.lit(c) for c in columns], sep), body, listed), folder)


def write_sample_files(samples: DataFrame, folder: str, bag: str = "values", order: str = "row_idx", suffix: str = ".csv") -> int:
    """A CSV file for each paper of samples (paper_id, row_idx, values): paper_id, then the sorted keys that its samples have; what one lacks is ''."""
    variant = typed.holds_variants(samples, bag)
    keys = samples.select("paper_id", F.explode(F.map_keys(bag)).alias("k")).where("k <> 'paper_id'").distinct()
    headers = samples.select("paper_id").distinct().join(keys.groupBy("paper_id").agg(F.array_sort(F.collect_list("k")).alias("keys")), "paper_id", "left")
    headers = headers.withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))

    def line(cells: Column) -> Column:
        quoted = F.transform(cells, lambda c: F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
        return F.array_join(quoted, ",")

    texts = F.transform("keys", lambda k: F.coalesce(cell_text(F.try_element_at(bag, k), variant), F.lit("")))
    body = samples.join(headers, "paper_id").select("paper_id", F.col(order).alias("at"), line(F.concat(F.array("paper_id"), texts)).alias("line"))
    header = line(F.concat(F.array(F.lit("paper_id")), F.col("keys")))
    return write_named(_with_header(F.concat("paper_id", F.lit(suffix)), header, body, headers), folder)


def write_json_files(docs: DataFrame, folder: str, suffix: str = ".json") -> int:
    """An indented JSON file for each row, named by its paper_id."""
    text = F.to_json(F.struct("*"), {"pretty": "true"})
    return write_named(docs.select(F.concat("paper_id", F.lit(suffix)).alias("name"), F.lit(0).alias("at"), text.alias("line")), folder, "\n")


# ------------------------------------------------------------- folders of part files


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """With a header, also when there are no rows."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("emptyValue", "").csv(path)


def write_cells(cells: DataFrame, path: str) -> None:
    """The per-cell table, tab-separated."""
    write_csv(cells.select("sample_idx", "ext_sample_id", "gold_sample_id", "field", "extracted", "gold", "decision"), path, "\t")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_pretty_json(df: DataFrame, path: str) -> None:
    """An indented document for each row."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def benchmark_report(by_study: DataFrame, totals: DataFrame, identifiers: frozenset[str] = IDENTIFIERS) -> str:
    """A block a study with its fields, then the fields over all studies; identifiers last.  Both tables are schema-sized."""
    rows = sorted(by_study.collect(), key=lambda r: (r.study, r.field in identifiers, r.field))
    lines: list[str] = []
    for k, r in enumerate(rows):
        lines += [f"## {r.study}"] if not k or rows[k - 1].study != r.study else []
        lines.append(_line(r.field, r))
    return "\n".join([*lines, "## all studies", *[_line(r.field, r) for r in sorted(totals.collect(), key=lambda r: (r.field in identifiers, r.field))]])


def repeats_report(summary: DataFrame, by: str, values: list[str]) -> tuple[str, list[dict]]:
    """Median and range of each value over repeated runs, as text and as rows for JSON."""
    rows = [r.asDict() for r in summary.orderBy(by).collect()]
    text = [f"{r[by]:<24} " + "  ".join(f"{v}={_shown(r[f'{v}_median'], 3)} [{_shown(r[f'{v}_min'], 3)}, {_shown(r[f'{v}_max'], 3)}]" for v in values) for r in rows]
    return "\n".join(text), rows


def _shown(x: float | None, digits: int = 2) -> str:
    return "-" if x is None else f"{x:.{digits}f}"


def _line(label: str, r) -> str:
    counts = " ".join(f"{k}={r[k]}" for k in ("n", "tn", "tp_correct", "tp_wrong", "fn", "fp"))
    rates = " ".join(f"{k}={_shown(r[k])}" for k in ("precision", "recall", "f1", "value_accuracy", "total_accuracy"))
    return f"{label:<24} {counts}  {rates}"


def text_report(
    by_field: DataFrame, total: DataFrame, strata: DataFrame | None = None, cells: DataFrame | None = None, most: int = 20,
    faithful: DataFrame | None = None, violations: DataFrame | None = None, most_violations: int = 8, identifiers: frozenset[str] = IDENTIFIERS,
) -> str:
    """Metrics of fields (identifiers last), of all, of strata, faithfulness, and the first violations and wrong cells."""
    rows = sorted(by_field.collect(), key=lambda r: (r.field in identifiers, r.field))
    lines = [_line(r.field, r) for r in rows] + [_line("all fields", total.first())]
    for r in sorted(strata.collect(), key=lambda r: (r.stratum, r.label)) if strata is not None else []:
        lines.append(_line(f"{r.stratum}: {r.label}", r))
    if faithful is not None:
        r = faithful.first()
        lines.append(f"quotes: {r.matched} of {r.checked} found ({_shown(r.rate)}), {r.violations} values without")
    for r in violations.orderBy("study", "field").limit(most_violations).collect() if violations is not None else []:
        lines.append(f"{r.study} {r.field}: {r.problem}")
    if cells is not None:
        bad = cells.where(F.col("decision").isin("TP_wrong", "FN", "FP")).orderBy("study", "sample_idx", "field").limit(most)
        lines += [f"{r.decision:<9} {r.sample_idx} {r.field}: {r.extracted!r} against {r.gold!r}" for r in bad.collect()]
    return "\n".join(lines)
