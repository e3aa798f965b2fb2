"""Registered queries of the exploration engine and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.classify import classify
from tabulon.functions.display import Format, formatted, grouped_integer
from tabulon.functions.output import neutralize
from tabulon.operators.columns import stats
from tabulon.operators.view import Hit, View
from tabulon.spec import DISPLAY_BYTES, ColumnType, Kind, Mode, SearchRequest
from tabulon.table import Table, open_table

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str]] = {}


def opened(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return open_table(spark, f"{sf_dir}/{name}.parquet")


def at(table: Table, label: str) -> int:
    return table.spec.labels.index(label)


def named(df: DataFrame, table: Table, labels: Sequence[str], *more: str) -> DataFrame:
    """Cells under their labels, after the numbering columns."""
    return df.select(*more, *(F.col(f"c{at(table, x)}").alias(x) for x in labels))


def request(table: Table, mode: Mode, value: str, column: str | None = None, scope: Sequence[str] | None = None, case: bool = False) -> SearchRequest:
    return SearchRequest(mode, value, None if column is None else at(table, column), None if scope is None else tuple(at(table, x) for x in scope), case)


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


def add(name: str, f: Query, sql: str) -> None:
    _FOUND[name] = (f, sql)


# -- SQL pieces. A table's rows with source rows; text of a double with two decimals; ASCII folding.
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NUMBERED = "(select row_number() over () - 1 as source_row, * from {})"
PLAIN = r"regexp_replace({}::varchar, '\.0$', '')"
CUSTOMER = f"select row_number() over () - 1 as source_row, c_custkey::varchar c0, c_name c1, c_nationkey::varchar c2, {PLAIN.format('c_acctbal')} c3, c_mktsegment c4 from customer"
PART = f"select row_number() over () - 1 as source_row, p_partkey::varchar c0, p_name c1, p_brand c2, p_type c3, p_size::varchar c4, {PLAIN.format('p_retailprice')} c5 from part"


def any_of(cells: int, value: str) -> str:
    return " or ".join(f"contains({FOLD.format(f'c{k}')}, '{value}')" for k in range(cells))


@query(f"select source_row, l_orderkey::varchar as l_orderkey, {PLAIN.format('l_quantity')} as l_quantity from {NUMBERED.format('lineitem')}")
def scan_source_rows(spark, sf_dir):
    t = opened(spark, sf_dir, "lineitem")
    return named(t.view().numbered, t, ["l_orderkey", "l_quantity"], "source_row")


@query("select c_name, c_mktsegment from customer")
def project_columns(spark, sf_dir):
    t = opened(spark, sf_dir, "customer")
    return named(t.rows, t, ["c_name", "c_mktsegment"])


@query(f"select row_number() over (order by source_row) - 1 as view_row, source_row, c1 as c_name from ({CUSTOMER}) where {any_of(5, '21')}")
def filter_text_any_column(spark, sf_dir):
    t = opened(spark, sf_dir, "customer")
    return named(t.where(request(t, Mode.TEXT, "21")).numbered, t, ["c_name"], "view_row", "source_row")


@query(f"select row_number() over (order by source_row) - 1 as view_row, source_row, doc_id::varchar as doc_id from {NUMBERED.format('documents')} where contains({FOLD.format('text')}, 'ation')")
def filter_text_scoped(spark, sf_dir):
    t = opened(spark, sf_dir, "documents")
    return named(t.where(request(t, Mode.TEXT, "ATION", scope=["text"])).numbered, t, ["doc_id"], "view_row", "source_row")


@query("select doc_id::varchar as doc_id from documents where contains(text, 'The ')")
def filter_text_case(spark, sf_dir):
    t = opened(spark, sf_dir, "documents")
    return named(t.where(request(t, Mode.TEXT, "The ", scope=["text"], case=True)).numbered, t, ["doc_id"])


@query(f"select source_row, c_mktsegment from {NUMBERED.format('customer')} where {FOLD.format('c_mktsegment')} = 'building'")
def filter_eq_fold(spark, sf_dir):
    t = opened(spark, sf_dir, "customer")
    return named(t.where(request(t, Mode.EQ, "buILding", "c_mktsegment")).numbered, t, ["c_mktsegment"], "source_row")


@query(f"select source_row, c_mktsegment from {NUMBERED.format('customer')} where {FOLD.format("coalesce(c_mktsegment, '')")} <> 'building'")
def filter_ne(spark, sf_dir):
    t = opened(spark, sf_dir, "customer")
    return named(t.where(request(t, Mode.NE, "BUILDING", "c_mktsegment")).numbered, t, ["c_mktsegment"], "source_row")


def _compare(name: str, mode: Mode, table: str, column: str, value: str) -> None:
    def run(spark, sf_dir):
        t = opened(spark, sf_dir, table)
        return t.where(request(t, mode, value, column)).numbered.select("view_row", "source_row")

    add(name, run, f"select row_number() over (order by source_row) - 1 as view_row, source_row from {NUMBERED.format(table)} where {column} {mode.value} {value}")


_compare("filter_lt", Mode.LT, "orders", "o_totalprice", "100000.5")
_compare("filter_gt", Mode.GT, "orders", "o_orderkey", "120")
_compare("filter_le", Mode.LE, "lineitem", "l_quantity", "10")
_compare("filter_ge", Mode.GE, "lineitem", "l_extendedprice", "40000.25")


@query(f"select source_row, case {' '.join(f"when contains({FOLD.format(f'c{k}')}, 'e') then {k}" for k in range(6))} end as match_column from ({PART}) where {any_of(6, 'e')}")
def match_column(spark, sf_dir):
    t = opened(spark, sf_dir, "part")
    return t.view().find(request(t, Mode.TEXT, "E")).matched.select("source_row", "match_column")


@query(f"select source_row // 2048 as block, count(*) as matches from {NUMBERED.format('lineitem')} where l_returnflag = 'R' group by all")
def block_counts(spark, sf_dir):
    t = opened(spark, sf_dir, "lineitem")
    return t.view().find(request(t, Mode.EQ, "r", "l_returnflag")).block_counts()


@query(f"select source_row as view_row, source_row, row_number() over (order by source_row) as position from ({PART}) where {any_of(6, '7')}")
def find_total_rank(spark, sf_dir):
    t = opened(spark, sf_dir, "part")
    return t.view().find(request(t, Mode.TEXT, "7")).ranked().select("view_row", "source_row", "position")


def _hit(spark: SparkSession, hit: Hit) -> DataFrame:
    return spark.createDataFrame([(hit.state.value, hit.row, hit.column, hit.position)], "state string, row long, match_column int, position long")


_RANKED = f"select source_row, row_number() over (order by source_row) as position, case {' '.join(f"when contains(c{k}, '7') then {k}" for k in range(6))} end as match_column from ({PART}) where {any_of(6, '7')}"


@query(f"select 'found' as state, source_row as row, match_column, position from ({_RANKED}) where source_row >= 100 order by source_row limit 1")
def find_next(spark, sf_dir):
    t = opened(spark, sf_dir, "part")
    return _hit(spark, t.view().find(request(t, Mode.TEXT, "7")).next(100))


@query(f"select 'found' as state, source_row as row, match_column, position from ({_RANKED}) where source_row < 100 order by source_row desc limit 1")
def find_previous(spark, sf_dir):
    t = opened(spark, sf_dir, "part")
    return _hit(spark, t.view().find(request(t, Mode.TEXT, "7")).previous(100))


_EVENTS = f"select row_number() over (order by source_row) - 1 as view_row, * from {NUMBERED.format('events')} where event_type = (select min(event_type) from events)"


@query(f"select view_row, source_row, row_number() over (order by view_row) as position from ({_EVENTS}) where value >= 50.5")
def find_under_filter(spark, sf_dir):
    t = opened(spark, sf_dir, "events")
    least = t.rows.agg(F.min(f"c{at(t, 'event_type')}")).first()[0]
    view = t.where(request(t, Mode.EQ, least, "event_type", case=True))
    return view.find(request(t, Mode.GE, "50.5", "value")).ranked().select("view_row", "source_row", "position")


def _sorted(name: str, table: str, column: str, descending: bool, sql_keys: Sequence[str], kind: str = "") -> None:
    def run(spark, sf_dir):
        t = opened(spark, sf_dir, table)
        return t.order_by(at(t, column), descending).numbered.select("view_row", "source_row")

    way = "desc" if descending else "asc"
    order = ", ".join(f"{k} {way} nulls {'last' if descending else 'first'}" for k in [*sql_keys, "source_row"])
    add(name, run, f"select row_number() over (order by {order}) - 1 as view_row, source_row from {NUMBERED.format(table)}{kind}")


_sorted("sort_text_asc", "part", "p_name", False, [FOLD.format("coalesce(p_name, '')"), "coalesce(p_name, '')"])
_sorted("sort_text_desc", "part", "p_type", True, [FOLD.format("coalesce(p_type, '')"), "coalesce(p_type, '')"])
_sorted("sort_numeric_asc", "orders", "o_totalprice", False, ["(o_totalprice is null)::int", "o_totalprice"])
_sorted("sort_numeric_desc", "lineitem", "l_quantity", True, ["(l_quantity is null)::int", "l_quantity"])
_sorted("sort_datetime", "events", "ts", False, ["(ts is null)::int", "ts"])


def _sorted_by_settings(name: str, column: str, settings: Callable[[Table, int], None], order: str) -> None:
    def run(spark, sf_dir):
        t = opened(spark, sf_dir, "orders")
        k = at(t, column)
        settings(t, k)
        return t.order_by(k).numbered.select("view_row", "source_row")

    add(name, run, f"select row_number() over (order by {order}, source_row) - 1 as view_row, source_row from {NUMBERED.format('orders')}")


_sorted_by_settings("sort_sentinel_last", "o_orderstatus", lambda t, k: t.columns.sentinel(k, "F"), f"(o_orderstatus = 'F')::int, case when o_orderstatus = 'F' then '' else {FOLD.format('o_orderstatus')} end, o_orderstatus")
# text that is no number goes behind as text; dates held as integers neither conform
_sorted_by_settings("sort_nonconforming", "o_orderpriority", lambda t, k: t.columns.override(k, ColumnType(Kind.INTEGER)), f"{FOLD.format('o_orderpriority')}, o_orderpriority")
_sorted_by_settings("sort_number_as_text", "o_orderkey", lambda t, k: t.columns.override(k, ColumnType(Kind.TEXT)), "o_orderkey::varchar")


@query(f"select row_number() over (order by o_totalprice desc, source_row desc) - 1 as view_row, source_row from {NUMBERED.format('orders')} where o_totalprice >= 250000")
def sort_over_filter(spark, sf_dir):
    t = opened(spark, sf_dir, "orders")
    view = t.where(request(t, Mode.GE, "250000", "o_totalprice")).order_by(at(t, "o_totalprice"), True)
    return view.numbered.select("view_row", "source_row")


@query(f"select * from (select row_number() over (order by o_totalprice, source_row) - 1 as view_row, source_row, o_orderkey::varchar as o_orderkey from {NUMBERED.format('orders')}) where view_row < 4096")
def topk_prefix(spark, sf_dir):
    t = opened(spark, sf_dir, "orders")
    return named(t.order_by(at(t, "o_totalprice")).prefix(), t, ["o_orderkey"], "view_row", "source_row")


_TOP = "select * from (select row_number() over (order by o_totalprice desc, source_row desc) - 1 as view_row, source_row, o_orderkey::varchar as o_orderkey from {} where o_totalprice >= 250000) where view_row < 50"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of at least 250,000, highest first, rows 0 to 49, with their source rows."""
    t = opened(spark, sf_dir, "orders")
    view = t.where(request(t, Mode.GE, "250000", "o_totalprice")).order_by(at(t, "o_totalprice"), True)
    return named(view.prefix(50), t, ["o_orderkey"], "view_row", "source_row")


add("flagship", flagship, _TOP.format(NUMBERED.format("orders")))


@query(f"select source_row as view_row, source_row, o_orderstatus from {NUMBERED.format('orders')} where source_row between 1000 and 1249")
def window_slice(spark, sf_dir):
    t = opened(spark, sf_dir, "orders")
    return named(t.view().window(1000, 250, [at(t, "o_orderstatus")]), t, ["o_orderstatus"], "view_row", "source_row")


@query(f"select * from (select row_number() over (order by o_totalprice, source_row) - 1 as view_row, source_row, o_totalprice::decimal(18,2)::varchar as price from {NUMBERED.format('orders')}) where view_row between 500 and 599")
def window_sorted(spark, sf_dir):
    t = opened(spark, sf_dir, "orders")
    k = at(t, "o_totalprice")
    got = t.order_by(k).window(500, 100, [k])
    return got.select("view_row", "source_row", F.col(f"c{k}").cast("decimal(18,2)").cast("string").alias("price"))


def _jump(name: str, view: Callable[[Table], View], sql: str) -> None:
    def run(spark, sf_dir):
        t = opened(spark, sf_dir, "orders")
        v = view(t)
        return spark.createDataFrame([(x, v.jump(x)) for x in (0, 700, 10**9)], "target long, view_row long")

    add(name, run, f"select target, {sql} as view_row from (values (0), (700), (1000000000)) as x(target)")


_KEPT = f"(select row_number() over (order by source_row) - 1 as view_row, source_row from {NUMBERED.format('orders')} where o_totalprice >= 250000)"
_ORDERED = f"(select row_number() over (order by o_totalprice, source_row) - 1 as view_row, source_row from {NUMBERED.format('orders')})"
_jump("jump_identity", lambda t: t.view(), "least(target, (select count(*) from orders) - 1)")
_jump("jump_filtered", lambda t: t.where(request(t, Mode.GE, "250000", "o_totalprice")), f"coalesce((select min(view_row) from {_KEPT} where source_row >= target), (select max(view_row) from {_KEPT}))")
_jump("jump_sorted", lambda t: t.order_by(at(t, "o_totalprice")), f"(select view_row from {_ORDERED} where source_row = least(target, (select count(*) from orders) - 1))")


@query(f"select source_row as view_row, contains({FOLD.format('c1')}, '1') as m1, contains({FOLD.format('c4')}, '1') as m4, contains({FOLD.format('c0')}, '1') as m0 from ({CUSTOMER}) where source_row < 100")
def match_flags(spark, sf_dir):
    t = opened(spark, sf_dir, "customer")
    return t.view().match_flags(request(t, Mode.TEXT, "1"), 0, 100, [0, 1, 4])


@query("select 'lineitem' as name, count(*) as n from lineitem union all select 'orders', count(*) from orders union all select 'documents', count(*) from documents")
def row_count(spark, sf_dir):
    return spark.createDataFrame([(x, opened(spark, sf_dir, x).count()) for x in ("lineitem", "orders", "documents")], "name string, n long")


@query("select count(*) as total from lineitem where l_shipdate::varchar like '1995-03%'")
def match_total(spark, sf_dir):
    t = opened(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(t.view().find(request(t, Mode.TEXT, "1995-03", scope=["l_shipdate"])).total,)], "total long")


_KIND = r"""case when lower(trim({0})) in ('true', 'false') then 'boolean' when regexp_full_match({0}, '[ \t\n\v\f\r]*[+-]?[0-9]+[ \t\n\v\f\r]*') then 'integer'
 when regexp_full_match({0}, '[ \t\n\v\f\r]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\v\f\r]*') then 'decimal'
 when regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast({0} as date) is not null then 'date' else 'text' end"""
_WORDS = "(select doc_id, unnest(string_split(text, ' ')) as word from documents)"


@query(f"select doc_id, kind, count(*) as n from (select doc_id, {_KIND.format('word')} as kind from {_WORDS}) group by all")
def classify_text(spark, sf_dir):
    t = opened(spark, sf_dir, "documents")
    words = t.rows.select(F.col(f"c{at(t, 'doc_id')}").cast("long").alias("doc_id"), F.explode(F.split(f"c{at(t, 'text')}", " ")).alias("word"))
    return words.select("doc_id", classify(F.col("word")).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


_STATS = "select '{0}' as \"column\", {1} from (select {2} as kind from events)"
_COUNTS = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in ("empty", "boolean", "integer", "decimal", "date", "datetime_naive", "datetime_zoned", "text"))


@query(
    " union all ".join(
        _STATS.format(c, _COUNTS, e)
        for c, e in (
            ("user_id", "case when user_id is null then 'empty' else 'integer' end"),
            ("value", "case when value is null then 'empty' when value = floor(value) then 'integer' else 'decimal' end"),
            ("ts", "case when ts is null then 'empty' else 'datetime_naive' end"),
            ("event_type", "case when coalesce(event_type, '') = '' then 'empty' else 'text' end"),
        )
    )
)
def infer_stats(spark, sf_dir):
    t = opened(spark, sf_dir, "events")
    labels = ["user_id", "value", "ts", "event_type"]
    return stats(named(t.rows, t, labels), labels)


_RISKY = r"case when regexp_matches({0}, '^[=@]') or (regexp_matches({0}, '^[+-]') and not regexp_full_match({0}, '[+-][0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?')) then '''' || {0} else {0} end"
_SIGNED = "case doc_id % 4 when 0 then '=' when 1 then '-' when 2 then '+1.5' else '' end || case when doc_id % 3 = 0 then '' else substr(text, 1, 40) end"


@query(f"select doc_id, {_RISKY.format('cell')} as safe from (select doc_id, {_SIGNED} as cell from documents)")
def neutralize_cells(spark, sf_dir):
    t = opened(spark, sf_dir, "documents")
    i, text = F.col(f"c{at(t, 'doc_id')}").cast("long"), F.col(f"c{at(t, 'text')}")
    sign = F.when(i % 4 == 0, "=").when(i % 4 == 1, "-").when(i % 4 == 2, "+1.5").otherwise("")
    cell = F.concat(sign, F.when(i % 3 == 0, "").otherwise(F.substring(text, 1, 40)))
    return t.rows.select(i.alias("doc_id"), neutralize(cell).alias("safe"))


_SIGN = "case coalesce(doc_id, 3) % 4 when 0 then '=' when 1 then '-' when 2 then '+1.5' else '' end"


@query(f"select source_row, doc_id, {_RISKY.format('cell')} as safe, {_RISKY.format('sign')} as safe_sign from (select source_row, doc_id, {_SIGN} as sign, {_SIGN} || coalesce(text, '') as cell from {NUMBERED.format('documents')})")
def neutralize_whole_cells(spark, sf_dir):
    """Signs before whole texts, and signs alone; neutralize_cells takes what its SQL does."""
    t = opened(spark, sf_dir, "documents")
    i, text = F.col(f"c{at(t, 'doc_id')}").cast("long"), F.coalesce(F.col(f"c{at(t, 'text')}"), F.lit(""))
    sign = F.when(i % 4 == 0, "=").when(i % 4 == 1, "-").when(i % 4 == 2, "+1.5").otherwise("")
    return t.view().numbered.select("source_row", i.alias("doc_id"), neutralize(F.concat(sign, text)).alias("safe"), neutralize(sign).alias("safe_sign"))


def _quoted(c: str) -> str:
    return f"case when regexp_matches({c}, '[\\t\\r\\n\"]') then '\"' || replace({c}, '\"', '\"\"') || '\"' else {c} end"


_SAFE_TEXT = _RISKY.format("text")


@query(f"select source_row as view_row, doc_id::varchar || chr(9) || {_quoted('safe')} || chr(9) || lang as line from (select *, {_SAFE_TEXT} as safe from {NUMBERED.format('documents')})")
def tsv_rows(spark, sf_dir):
    t = opened(spark, sf_dir, "documents")
    return t.view().tsv_rows(0, 1 << 40, [at(t, x) for x in ("doc_id", "text", "lang")])


@query("select o_orderkey, format('{:,}', o_orderkey) as shown from orders")
def format_int_group(spark, sf_dir):
    t = opened(spark, sf_dir, "orders")
    c = F.col(f"c{at(t, 'o_orderkey')}")
    return t.rows.select(c.cast("long").alias("o_orderkey"), grouped_integer(c).alias("shown"))


_CENTS = "(select o_orderkey, round(o_totalprice * 100)::bigint as cents from orders)"
_TENTHS = f"(select *, cents // 10 + case when cents % 10 > 5 or (cents % 10 = 5 and cents // 10 % 2 = 1) then 1 else 0 end as tenths from {_CENTS})"


@query(f"select o_orderkey, case when cents % 100 = 0 then (cents // 100)::varchar else format('{{:,}}', tenths // 10) || '.' || (tenths % 10)::varchar end as shown from {_TENTHS}")
def format_decimal_half_even(spark, sf_dir):
    t = opened(spark, sf_dir, "orders")
    shown = formatted(F.col(f"c{at(t, 'o_totalprice')}"), ColumnType(Kind.DECIMAL), Format(grouping=True, fraction_digits=1))
    return t.rows.select(F.col(f"c{at(t, 'o_orderkey')}").cast("long").alias("o_orderkey"), shown["text"].alias("shown"))


@query("select o_orderkey::varchar as o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '000' as o_orderdate from orders")
def render_timestamp(spark, sf_dir):
    t = opened(spark, sf_dir, "orders")
    return named(t.rows, t, ["o_orderkey", "o_orderdate"])


@query(f"select l_orderkey::varchar as l_orderkey, {PLAIN.format('l_extendedprice')} as l_extendedprice, {PLAIN.format('l_discount')} as l_discount from lineitem")
def render_double(spark, sf_dir):
    t = opened(spark, sf_dir, "lineitem")
    return named(t.rows, t, ["l_orderkey", "l_extendedprice", "l_discount"])


@query(f"select doc_id::varchar as doc_id, strlen(text) > {DISPLAY_BYTES} as truncated, true as begins from documents where doc_id < 2000 and length(text) > 0")
def display_cap(spark, sf_dir):
    t = opened(spark, sf_dir, "documents")
    i, k = at(t, "doc_id"), at(t, "text")
    from tabulon.functions.text import cap

    shown = cap(F.col(f"c{k}"), DISPLAY_BYTES)
    rows = t.where(request(t, Mode.LT, "2000", "doc_id")).numbered.where(F.length(f"c{k}") > 0)
    whole = F.col(f"c{k}").startswith(shown["text"]) & (F.octet_length(shown["text"]) <= DISPLAY_BYTES)
    return rows.select(F.col(f"c{i}").alias("doc_id"), shown["truncated"].alias("truncated"), whole.alias("begins"))


@query(f"select source_row, doc_id::varchar as doc_id, strlen(coalesce(text, '')) > {DISPLAY_BYTES} as truncated, true as begins from {NUMBERED.format('documents')}")
def display_cap_whole(spark, sf_dir):
    """Every row of the table; display_cap shows those of its SQL only."""
    t = opened(spark, sf_dir, "documents")
    from tabulon.functions.text import cap

    text = F.coalesce(F.col(f"c{at(t, 'text')}"), F.lit(""))
    shown = cap(text, DISPLAY_BYTES)
    whole = text.startswith(shown["text"]) & (F.octet_length(shown["text"]) <= DISPLAY_BYTES)
    return t.view().numbered.select("source_row", F.col(f"c{at(t, 'doc_id')}").alias("doc_id"), shown["truncated"].alias("truncated"), whole.alias("begins"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


# the rest of the catalogue registers itself
from tabulon import catalogue_net, catalogue_rules, catalogue_text  # noqa: E402, F401
