"""Registered queries over text sources, inference, typed sorts of text, and Parquet values: the tables are written as the
source in question in the shared folder, opened, and held against SQL over the tables themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.catalogue import NUMBERED, PLAIN, at, named, opened, query, request
from tabulon.functions import numeric
from tabulon.functions.display import Format, Preset, formatted
from tabulon.functions.text import trim
from tabulon.plans.numbering import new_path
from tabulon.sources import delimited, parquet
from tabulon.spec import ColumnType, Kind, Mode, OpenOptions, SearchRequest
from tabulon.table import Table, open_table


def source_of(spark: SparkSession, sf_dir: str, name: str, cells: Sequence[tuple[str, Column]], separator: str = ",", quote: str = '"', encoding: str = "UTF-8", gzip: bool = False, header: bool = True) -> str:
    """A table's cells as one delimited file in source order; every cell is quoted if there is a quote."""
    t = opened(spark, sf_dir, name)
    mark = lambda c: F.concat(F.lit(quote), F.replace(c, F.lit(quote), F.lit(quote * 2)), F.lit(quote)) if quote else c
    line = lambda parts: F.concat_ws(separator, *map(mark, parts))
    rows = named(t.view().numbered, t, t.spec.labels, "source_row").select("source_row", line([F.coalesce(c.cast("string"), F.lit("")) for _, c in cells]).alias("line"))
    if header:
        rows = rows.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("source_row"), line([F.lit(n) for n, _ in cells]).alias("line")))
    # one file in order, as a delimited table is; only its bytes go out, in whatever encoding
    text = rows.repartition(1).sortWithinPartitions("source_row").select(F.encode("line", encoding).cast("string").alias("value"))
    path = new_path(spark, "source")
    text.write.option("lineSep", "\n").option("encoding", encoding).option("compression", "gzip" if gzip else "none").text(path)
    return spark.read.format("binaryFile").load(path).select("path").where(F.col("path").rlike("/part-")).first()[0]


def text_table(spark: SparkSession, sf_dir: str, name: str, labels: Sequence[str], options: OpenOptions = OpenOptions(), **how) -> Table:
    return open_table(spark, source_of(spark, sf_dir, name, [(x, F.col(x)) for x in labels], **how), options)


def mixed_table(spark: SparkSession, sf_dir: str) -> Table:
    """lineitem with numbers, days, flags, an empty column, and words among numbers in rows 100 to 119."""
    odd = F.when(F.col("source_row").between(100, 119), F.col("l_returnflag")).otherwise(F.col("l_linenumber"))
    cells = [("number", F.col("l_linenumber")), ("day", F.substring("l_shipdate", 1, 10)), ("flag", F.col("l_returnflag")), ("none", F.lit("")), ("odd", odd)]
    return open_table(spark, source_of(spark, sf_dir, "lineitem", cells))


@query(f"select source_row, doc_id::varchar as doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang from {NUMBERED.format('documents')}")
def csv_scan(spark, sf_dir):
    t = text_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    return named(t.rows, t, ["doc_id", "text", "lang"], "source_row")


_CUSTOMERS = f"select source_row, c_custkey::varchar as c_custkey, c_name, {PLAIN.format('c_acctbal')} as c_acctbal from {NUMBERED.format('customer')}"
_LABELS = ["c_custkey", "c_name", "c_acctbal"]


@query(_CUSTOMERS)
def csv_gzip(spark, sf_dir):
    t = text_table(spark, sf_dir, "customer", _LABELS, gzip=True)
    return named(t.rows, t, _LABELS, "source_row")


@query(_CUSTOMERS)
def csv_utf16(spark, sf_dir):
    """Without a mark: told by its zeros."""
    t = text_table(spark, sf_dir, "customer", _LABELS, encoding="UTF-16LE")
    return named(t.rows, t, _LABELS, "source_row")


@query(f"select source_row, p_name || 'é' as name, p_brand || 'ß' as brand from {NUMBERED.format('part')}")
def csv_latin1(spark, sf_dir):
    t = open_table(spark, source_of(spark, sf_dir, "part", [("name", F.concat("p_name", F.lit("é"))), ("brand", F.concat("p_brand", F.lit("ß")))], encoding="ISO-8859-1"))
    return named(t.rows, t, ["name", "brand"], "source_row")


@query("select * from (values (',', '\"', 'utf-8'), (';', '''', 'utf-8'), (chr(9), '\"', 'utf-8'), ('|', '''', 'utf-16-le')) as x(separator, quote, encoding), (select true as has_header, 3 as columns, false as parquet)")
def dialect_facts(spark, sf_dir):
    """What is detected of four dialects."""
    found = []
    for separator, quote, encoding in ((",", '"', "UTF-8"), (";", "'", "UTF-8"), ("\t", '"', "UTF-8"), ("|", "'", "UTF-16LE")):
        s = text_table(spark, sf_dir, "customer", _LABELS, separator=separator, quote=quote, encoding=encoding).spec
        found.append((s.dialect.separator, s.dialect.quote, s.dialect.encoding, s.dialect.has_header, s.column_count, s.is_parquet))
    return spark.createDataFrame(found, "separator string, quote string, encoding string, has_header boolean, columns int, parquet boolean")


@query("select 'numbers' as first_record, false as has_header, count(*) as n from lineitem union all select 'numbers, header forced', true, count(*) - 1 from lineitem union all select 'labels', true, count(*) from lineitem")
def header_rule(spark, sf_dir):
    """Record 1 of numbers alone is data unless a header is forced."""
    labels = ["l_orderkey", "l_linenumber"]
    plain = source_of(spark, sf_dir, "lineitem", [(x, F.col(x)) for x in labels], header=False)
    tables = [("numbers", open_table(spark, plain)), ("numbers, header forced", open_table(spark, plain, OpenOptions(header=True))), ("labels", text_table(spark, sf_dir, "lineitem", labels))]
    return spark.createDataFrame([(n, t.spec.dialect.has_header, t.count()) for n, t in tables], "first_record string, has_header boolean, n long")


@query("select n_name, n_regionkey::varchar as n_regionkey from nation")
def csv_selected_columns(spark, sf_dir):
    t = text_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    rows = delimited.load(spark, t.spec, [1, 2])
    return rows.select(F.col("c1").alias("n_name"), F.col("c2").alias("n_regionkey"))


@query(f"select source_row, doc_id::varchar as doc_id from {NUMBERED.format('documents')}")
def csv_split_rows(spark, sf_dir):
    """Split where quoted line ends lie in the way; every split knows its first row."""
    t = text_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return delimited.load(spark, t.spec, [0], step=max(1 << 16, t.spec.size_bytes // 16)).select("source_row", F.col("c0").alias("doc_id"))


@query(f"select row_number() over (order by source_row) - 1 as view_row, source_row, o_orderkey::varchar as o_orderkey from {NUMBERED.format('orders')} where o_totalprice >= 250000.5")
def csv_filter(spark, sf_dir):
    t = text_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])
    return named(t.where(request(t, Mode.GE, "250000.5", "o_totalprice")).numbered, t, ["o_orderkey"], "view_row", "source_row")


@query(f"select source_row as view_row, source_row, o_orderkey::varchar as o_orderkey from {NUMBERED.format('orders')} where source_row between 900 and 999")
def csv_window(spark, sf_dir):
    t = text_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])
    return named(t.view().window(900, 100, [0]), t, ["o_orderkey"], "view_row", "source_row")


def _sorted_text(spark, sf_dir, cell: Column, kind: Kind, descending: bool = False) -> DataFrame:
    t = open_table(spark, source_of(spark, sf_dir, "orders", [("cell", cell)]))
    t.columns.override(0, ColumnType(kind))
    return t.order_by(0, descending).numbered.select("view_row", "source_row")


@query(f"select row_number() over (order by o_totalprice desc, source_row desc) - 1 as view_row, source_row from {NUMBERED.format('orders')}")
def sort_exact_key(spark, sf_dir):
    """Numbers as text, by their exact keys."""
    return _sorted_text(spark, sf_dir, F.col("o_totalprice"), Kind.DECIMAL, True)


_TENTHS = "(round(o_totalprice * 100)::bigint // 10)"


@query(f"select row_number() over (order by ({_TENTHS} % 10 <> 0)::int, case when {_TENTHS} % 10 = 0 then {_TENTHS} end, case when {_TENTHS} % 10 <> 0 then {_TENTHS} // 10 || '.' || {_TENTHS} % 10 end, source_row) - 1 as view_row, source_row from {NUMBERED.format('orders')}")
def sort_integer_conformance(spark, sf_dir):
    """Of an integer column, numbers with a point go behind as text."""
    tenths = F.floor(F.round(F.col("o_totalprice").cast("double") * 100) / 10)
    cell = F.when(tenths % 10 == 0, (tenths / 10).cast("long").cast("string")).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("int").cast("string")))
    return _sorted_text(spark, sf_dir, cell, Kind.INTEGER)


@query(f"select row_number() over (order by (o_orderkey % 3 = 2)::int, case o_orderkey % 3 when 0 then 0 when 1 then 1 end, source_row) - 1 as view_row, source_row from {NUMBERED.format('orders')}")
def sort_boolean(spark, sf_dir):
    key = F.col("o_orderkey").cast("long") % 3
    return _sorted_text(spark, sf_dir, F.when(key == 0, " FALSE").when(key == 1, "True").otherwise("maybe"), Kind.BOOLEAN)


@query(f"select row_number() over (order by o_orderdate, source_row) - 1 as view_row, source_row from {NUMBERED.format('orders')}")
def sort_date_text(spark, sf_dir):
    return _sorted_text(spark, sf_dir, F.substring("o_orderdate", 1, 10), Kind.DATE)


_BY_PRICE = f"(select row_number() over (order by o_totalprice, source_row) - 1 as view_row, * from {NUMBERED.format('orders')})"


@query(f"select view_row, source_row, row_number() over (order by view_row) as position from {_BY_PRICE} where o_orderpriority = '5-LOW'")
def find_under_sort(spark, sf_dir):
    t = opened(spark, sf_dir, "orders")
    view = t.order_by(at(t, "o_totalprice"))
    return view.find(request(t, Mode.EQ, "5-low", "o_orderpriority")).ranked().select("view_row", "source_row", "position")


@query(f"select source_row, view_row as up, (select count(*) from orders) - 1 - view_row as down from {_BY_PRICE}")
def sort_flip(spark, sf_dir):
    """Both directions from one ranking."""
    t = opened(spark, sf_dir, "orders")
    k = at(t, "o_totalprice")
    up, down = (t.order_by(k, way).numbered.select("source_row", "view_row") for way in (False, True))
    return up.withColumnRenamed("view_row", "up").join(down.withColumnRenamed("view_row", "down"), "source_row")


@query(f"select source_row, row_number() over (order by o_orderkey, source_row) - 1 as before, row_number() over (order by o_orderkey::varchar, source_row) - 1 as after from {NUMBERED.format('orders')}")
def sort_type_capture(spark, sf_dir):
    """A sort keeps the type that its column had when it was made."""
    t = opened(spark, sf_dir, "orders")
    k = at(t, "o_orderkey")
    before = t.order_by(k)
    t.columns.override(k, ColumnType(Kind.TEXT))
    after = t.order_by(k).numbered.select("source_row", F.col("view_row").alias("after"))
    return before.numbered.select("source_row", F.col("view_row").alias("before")).join(after, "source_row")


# -- inference


def _told(spark: SparkSession, found) -> DataFrame:
    rows = [(m.label, m.effective.kind.value, m.effective.precision, m.effective.scale, m.state.value, m.confidence.value, m.evidence, m.rows, m.empty, m.null, m.conflict.value, m.conflicts, m.conflict_row, m.conflict_example, m.proposal and m.proposal.kind.value) for m in found]
    return spark.createDataFrame(rows, "label string, kind string, precision long, scale long, state string, confidence string, evidence long, rows long, empty long, nulls long, conflict string, conflicts long, conflict_row long, conflict_example string, proposal string")


_HEAD = f"(select * from {NUMBERED.format('lineitem')} where source_row < 256)"
_NO_CONFLICT = "'none' as conflict, 0 as conflicts, null::bigint as conflict_row, null::varchar as conflict_example, null::varchar as proposal"
_SEEN = f"(select count(*) as n, (select count(*) from lineitem) <= 256 as whole from {_HEAD})"


def _plain_kind(label: str, kind: str, digits: str) -> str:
    return f"select '{label}' as label, '{kind}' as kind, {digits}, 'published' as state, case when whole then 'exhaustive' else 'bounded' end as confidence, n as evidence, n as rows, 0 as empty, 0 as nulls, {_NO_CONFLICT} from {_SEEN}"


_NONE = "null::bigint as precision, null::bigint as scale"


@query(
    f"{_plain_kind('number', 'integer', '1 as precision, 0 as scale')} union all {_plain_kind('day', 'date', _NONE)} union all {_plain_kind('flag', 'text', _NONE)} union all "
    f"select 'none', 'unknown', {_NONE}, case when whole then 'published' else 'provisional' end, case when whole then 'exhaustive' else 'none' end, 0, n, n, 0, {_NO_CONFLICT} from {_SEEN}"
)
def infer_columns(spark, sf_dir):
    t = mixed_table(spark, sf_dir)
    return _told(spark, t.columns.infer([0, 1, 2, 3, 0]))


_ODD = f"(select source_row, case when source_row between 100 and 119 then l_returnflag else l_linenumber::varchar end as cell from {_HEAD})"


@query(
    f"select 'odd' as label, 'integer' as kind, 1 as precision, 0 as scale, 'published' as state, case when whole then 'exhaustive' else 'bounded' end as confidence, n - 20 as evidence, n as rows, 0 as empty, 0 as nulls, "
    f"'proposed' as conflict, 20 as conflicts, 100 as conflict_row, (select cell from {_ODD} where source_row = 100) as conflict_example, 'text' as proposal from {_SEEN}"
)
def infer_conflicts(spark, sf_dir):
    t = mixed_table(spark, sf_dir)
    return _told(spark, t.columns.infer([4]))


@query(
    f"select 'odd' as label, 'text' as kind, {_NONE}, 'published' as state, case when whole then 'exhaustive' else 'bounded' end as confidence, n - 20 as evidence, n as rows, 0 as empty, 0 as nulls, {_NO_CONFLICT} from {_SEEN}"
)
def infer_accept(spark, sf_dir):
    t = mixed_table(spark, sf_dir)
    t.columns.infer([4])
    t.columns.accept_proposal(4)
    return _told(spark, [t.columns.metadata(4)])


@query(
    f"select 'number' as label, 'date' as kind, {_NONE}, 'published' as state, case when whole then 'exhaustive' else 'bounded' end as confidence, n as evidence, n as rows, 0 as empty, 0 as nulls, "
    f"'observed' as conflict, n as conflicts, 0 as conflict_row, (select l_linenumber::varchar from {_HEAD} where source_row = 0) as conflict_example, null::varchar as proposal from {_SEEN}"
)
def infer_override(spark, sf_dir):
    t = mixed_table(spark, sf_dir)
    t.columns.infer([0])
    t.columns.override(0, ColumnType(Kind.DATE))
    return _told(spark, [t.columns.metadata(0)])


@query(
    f"select 'number' as label, 'integer' as kind, 1 as precision, 0 as scale, 'published' as state, case when whole then 'exhaustive' else 'bounded' end as confidence, n - m as evidence, n as rows, 0 as empty, m as nulls, {_NO_CONFLICT} "
    f"from {_SEEN}, (select count(*) as m from {_HEAD} where l_linenumber = 3)"
)
def infer_sentinel(spark, sf_dir):
    t = mixed_table(spark, sf_dir)
    t.columns.infer([0])
    t.columns.sentinel(0, "3")
    return _told(spark, [t.columns.metadata(0)])


@query(f"select least((select count(*) from lineitem), 264) as rows, count(*) filter (l_linenumber = 1) as ones, greatest(0, least(8, (select count(*) from lineitem) - 256)) as shown from (select * from {NUMBERED.format('lineitem')} where source_row < 264)")
def infer_window_evidence(spark, sf_dir):
    """Rows that are looked at count once, behind the head's."""
    t = mixed_table(spark, sf_dir)
    t.columns.sentinel(0, "1")
    before = t.columns.infer([0])[0].rows
    window = [(r["source_row"], {0: r["c0"]}) for r in t.view().window(256, 8, [0]).collect()]
    t.columns.observe(window + window)
    m = t.columns.metadata(0)
    return spark.createDataFrame([(m.rows, m.null, m.rows - before)], "rows long, ones long, shown long")


@query("select * from (values ('l_orderkey', 'integer'), ('l_partkey', 'integer'), ('l_suppkey', 'integer'), ('l_linenumber', 'integer'), ('l_quantity', 'decimal'), ('l_extendedprice', 'decimal'), ('l_discount', 'decimal'), ('l_tax', 'decimal'), ('l_returnflag', 'text'), ('l_linestatus', 'text'), ('l_shipdate', 'datetime')) as x(label, kind)")
def infer_parquet(spark, sf_dir):
    """Declared types need no evidence."""
    t = opened(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(m.label, m.effective.kind.value) for m in t.columns.infer(range(t.spec.column_count))], "label string, kind string")


@query("select column_no as \"column\", label, kind from (values (0, 3, 'n_regionkey', 'integer'), (1, 0, 'n_nationkey', 'integer'), (2, 3, 'n_regionkey', 'integer'), (3, 1, 'n_name', 'text')) as x(place, column_no, label, kind) where false union all select * from (values (2, 'n_regionkey', 'integer'), (0, 'n_nationkey', 'integer'), (2, 'n_regionkey', 'integer'), (1, 'n_name', 'text'))")
def labels_batch(spark, sf_dir):
    """Metadata in the caller's order, repeats allowed."""
    t = opened(spark, sf_dir, "nation")
    return spark.createDataFrame([(m.column, m.label, m.effective.kind.value) for m in t.columns.batch([2, 0, 2, 1])], "column int, label string, kind string")


# -- Parquet


def _written(df: DataFrame, *by: str) -> str:
    path = new_path(df.sparkSession, "parquet")
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return path


@query("select count(*) as n, count(*) as rows, 0 as first, count(*) - 1 as last, sum(o_orderkey)::bigint as keys from orders")
def parquet_folder(spark, sf_dir):
    """A folder partitioned by a column: source rows run through all its files."""
    path = _written(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderstatus")
    t = open_table(spark, path)
    rows = t.view().numbered
    return rows.agg(F.count("*").alias("n"), F.countDistinct("source_row").alias("rows"), F.min("source_row").alias("first"), F.max("source_row").alias("last"), F.sum(F.col(f"c{at(t, 'o_orderkey')}").cast("long")).alias("keys"))


@query("select o_orderkey::varchar as o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' as zoned, (round(o_totalprice * 100)::bigint / 100)::decimal(18,2)::decimal(18,4)::varchar as price, (o_orderkey % 2 = 0)::varchar as even from orders")
def render_values(spark, sf_dir):
    """Days, zoned moments, decimals and booleans as text; zoned ones are UTC whatever the session's zone."""
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")
    made = raw.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.timestamp_micros(micros).alias("zoned"), F.col("o_totalprice").cast("decimal(18,2)").cast("decimal(18,4)").alias("price"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    t = open_table(spark, _written(made))
    return named(t.rows, t, ["o_orderkey", "day", "zoned", "price", "even"])


@query("select count(*) as rows, 11 as columns, count(*) as rows_of_groups, true as groups_follow from lineitem")
def parquet_footer(spark, sf_dir):
    path = f"{sf_dir}/lineitem.parquet"
    info, groups = parquet.file_info(path), parquet.row_groups(path)
    follow = all(a.first_row + a.rows == b.first_row for a, b in zip(groups, groups[1:], strict=False))
    return spark.createDataFrame([(info.rows, info.columns, sum(g.rows for g in groups), follow)], "rows long, columns int, rows_of_groups long, groups_follow boolean")


@query("select * from (values (0, 'o_orderkey', 'INT64', true), (1, 'o_custkey', 'INT64', true), (2, 'o_orderstatus', 'BYTE_ARRAY', true), (3, 'o_totalprice', 'DOUBLE', true), (4, 'o_orderdate', 'INT64', true), (5, 'o_orderpriority', 'BYTE_ARRAY', true)) as x(\"column\", label, physical, nullable)")
def parquet_columns(spark, sf_dir):
    found = parquet.column_info(f"{sf_dir}/orders.parquet")
    return spark.createDataFrame([(c.column, c.label, c.physical, c.nullable) for c in found], "column int, label string, physical string, nullable boolean")


# -- values


_CENTS = "(select s_suppkey, s_acctbal < 0 as negative, abs(round(s_acctbal * 100))::bigint as cents from supplier)"
_DIGITS = f"(select *, case when cents = 0 then '' else rtrim(cents::varchar, '0') end as digits, length(cents::varchar) - 3 as first from {_CENTS})"


@query(f"select s_suppkey, negative, digits, first, length(digits)::bigint as precision, length(digits) - 1 - first as scale from {_DIGITS} where cents > 0")
def parse_decimal(spark, sf_dir):
    """Sign, significant digits and exponent of numbers as text."""
    import pyarrow as pa

    t = opened(spark, sf_dir, "supplier")

    def run(batches):
        for batch in batches:
            found = [(k, numeric.parse(x)) for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [(k, n.negative, n.digits, n.first, n.precision, n.scale) for k, n in found if n.digits]
            kinds = (pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ["s_suppkey", "negative", "digits", "first", "precision", "scale"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    cells = named(t.rows, t, ["s_suppkey", "s_acctbal"]).select(F.col("s_suppkey").cast("long"), "s_acctbal")
    return cells.mapInArrow(run, "s_suppkey long, negative boolean, digits string, first long, precision long, scale long")


@query("select p_partkey, trim(' ' || chr(9) || p_name || chr(10) || ' ', ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed, chr(160) || p_brand as kept from part")
def ascii_trim(spark, sf_dir):
    t = opened(spark, sf_dir, "part")
    rows = named(t.rows, t, ["p_partkey", "p_name", "p_brand"])
    return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), trim(F.concat(F.lit(" \t"), "p_name", F.lit("\n "))).alias("trimmed"), trim(F.concat(F.lit(" "), "p_brand")).alias("kept"))


@query("select o_orderkey, strftime(o_orderdate, '%m/%d/%y') as short, monthname(o_orderdate)[1:3] || ' ' || lpad(day(o_orderdate)::varchar, 2, ' ') || ', ' || year(o_orderdate) as medium, dayname(o_orderdate) || ', ' || monthname(o_orderdate) || ' ' || lpad(day(o_orderdate)::varchar, 2, ' ') || ', ' || year(o_orderdate) as long, strftime(o_orderdate, '%Y-%m-%d') as original, 'original' as mismatch from orders")
def format_dates(spark, sf_dir):
    """Presets of days; a cell of another kind is shown as written."""
    t = opened(spark, sf_dir, "orders")
    day = F.substring(F.col(f"c{at(t, 'o_orderdate')}"), 1, 10)
    key = F.col(f"c{at(t, 'o_orderkey')}")
    shown = lambda p: formatted(day, ColumnType(Kind.DATE), Format(preset=p))["text"].alias(p.value)
    return t.rows.select(key.cast("long").alias("o_orderkey"), *map(shown, (Preset.SHORT, Preset.MEDIUM, Preset.LONG, Preset.ORIGINAL)), formatted(key, ColumnType(Kind.DATE), Format(preset=Preset.LONG))["state"].alias("mismatch"))


@query("select max(length(c_name))::bigint as name, max(length(c_mktsegment))::bigint as segment from (select * from customer limit 100)")
def content_width(spark, sf_dir):
    t = opened(spark, sf_dir, "customer")
    got = t.view().content_widths(0, 100, [at(t, "c_name"), at(t, "c_mktsegment")])
    return spark.createDataFrame([tuple(got.values())], "name long, segment long")


@query("select 0 as row, n_name as text, 'ok' as state from (select * from nation limit 1) union all select 100, '', 'no cell'")
def full_cell(spark, sf_dir):
    t = opened(spark, sf_dir, "nation")
    cells = [(row, *t.view().read_cell(row, at(t, "n_name"))) for row in (0, 100)]
    return spark.createDataFrame([(row, text, state.value) for row, state, text in cells], "row long, text string, state string")


@query(f"select string_agg(n_nationkey || chr(9) || n_name, chr(10) order by source_row) as text, count(*) as rows, false as capped from {NUMBERED.format('nation')}")
def copy_tsv(spark, sf_dir):
    t = opened(spark, sf_dir, "nation")
    got = t.view().copy(0, 1 << 40, [0, 1])
    return spark.createDataFrame([(got.text, got.rows, got.capped)], "text string, rows long, capped boolean")


@query(f"select source_row as view_row, strlen(n_name) * 120000 + 1 > 1048576 as oversized from {NUMBERED.format('nation')}")
def oversized_rows(spark, sf_dir):
    t = open_table(spark, source_of(spark, sf_dir, "nation", [("wide", F.repeat("n_name", F.lit(120_000)))], quote=""), OpenOptions(quote="", separator=","))
    return t.view().oversized(0, 1000)


@query("select true as near, 0 as jobs")
def estimated_count(spark, sf_dir):
    """Rows by the head alone, without a job, within a tenth of the exact number."""
    t = text_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice", "l_shipdate"])
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    guess, _ = t.estimated_count
    jobs = len(tracker.getJobIdsForGroup(None)) - before
    n = t.count()
    return spark.createDataFrame([(abs(guess - n) <= 0.1 * n, jobs)], "near boolean, jobs int")


@query("select count(*) filter (c_mktsegment = 'BUILDING') as first, count(*) filter (c_mktsegment = 'BUILDING') as second, 1 as counted from customer")
def request_cache(spark, sf_dir):
    """Requests of equal meaning are counted once."""
    t = opened(spark, sf_dir, "customer")
    k = at(t, "c_mktsegment")
    totals = [t.view().find(SearchRequest(Mode.EQ, "building", k, case_sensitive=c)).total for c in (False, False)]
    return spark.createDataFrame([(*totals, len(t.totals))], "first long, second long, counted int")
