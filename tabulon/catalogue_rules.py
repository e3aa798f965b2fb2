"""Registered queries of the small decisions around a table: what a caller's request means and what its user is told. Each is
held against the plain list of what should come out, or against counts by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.catalogue import at, opened, query, request
from tabulon.errors import InvalidArgument
from tabulon.functions.classify import type_of
from tabulon.operators import rules
from tabulon.operators.columns import alignment, keeps_settings, search_labels
from tabulon.operators.evidence import joined
from tabulon.operators.jobs import Job, JobState, header_shift, jump_field, next_sort
from tabulon.operators.view import Found
from tabulon.spec import Kind, Mode, OpenOptions, TableSpec


def told(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def refused(make) -> bool:
    try:
        make()
    except InvalidArgument:
        return True
    return False


@query("select * from (values ('1', 0), ('0', null), ('-1', null), ('12a', null), ('', null), ('007', 6), ('18446744073709551616', null), (' 5', null)) as x(typed, row)")
def jump_fields(spark, sf_dir):
    return told(spark, [(x, jump_field(x)) for x in ("1", "0", "-1", "12a", "", "007", "18446744073709551616", " 5")], "typed string, row long")


@query("select * from (values (1, 'ascending'), (2, 'descending'), (3, 'clear'), (4, 'ascending'), (5, 'retry'), (6, 'clear')) as x(click, action)")
def sort_cycle(spark, sf_dir):
    asked = [(None, False, 1), (1, False, 1), (1, True, 1), (1, True, 2), (1, False, 1, JobState.FAILED), (1, False, 1, JobState.RUNNING)]
    return told(spark, [(k + 1, next_sort(*a).value) for k, a in enumerate(asked)], "click int, action string")


@query("select * from (values (false, true, -1), (true, false, 1), (true, true, 0), (false, false, 0)) as x(before, after, shift)")
def header_toggle(spark, sf_dir):
    return told(spark, [(a, b, header_shift(a, b)) for a, b in ((False, True), (True, False), (True, True), (False, False))], "before boolean, after boolean, shift int")


@query("select * from (values ('separator LF', true), ('separator of two', true), ('quote beyond ASCII', true), ('separator and quote alike', true), ('unknown encoding', true), ('no quote', false), ('all forced', false)) as x(options, refused)")
def option_validation(spark, sf_dir):
    cases = [
        ("separator LF", {"separator": "\n"}), ("separator of two", {"separator": ",,"}), ("quote beyond ASCII", {"quote": "é"}), ("separator and quote alike", {"separator": "|", "quote": "|"}),
        ("unknown encoding", {"encoding": "ebcdic"}), ("no quote", {"quote": ""}), ("all forced", {"separator": ";", "quote": "'", "encoding": "latin-1", "header": False}),
    ]
    return told(spark, [(name, refused(lambda o=o: OpenOptions(**o))) for name, o in cases], "options string, refused boolean")


@query("select * from (values ('separator', ';', null, false), ('quote', ';', '''', false), ('collision', null, null, true)) as x(change, separator, quote, refused)")
def dialect_composer(spark, sf_dir):
    """One parameter after the other is forced; the rest stays to be detected."""
    one = rules.compose_dialect(OpenOptions(), separator=";")
    two = rules.compose_dialect(one, quote="'")
    clash = refused(lambda: rules.compose_dialect(two, separator="'"))
    return told(spark, [("separator", one.separator, one.quote, False), ("quote", two.separator, two.quote, False), ("collision", None, None, clash)], "change string, separator string, quote string, refused boolean")


@query("select * from (values (';', false), ('ab', true), ('', true), ('é', true), (chr(13), true), (chr(9), false)) as x(typed, refused)")
def custom_bytes(spark, sf_dir):
    return told(spark, [(x, refused(lambda x=x: rules.custom_byte(x))) for x in (";", "ab", "", "é", "\r", "\t")], "typed string, refused boolean")


@query("select * from (values ('hide 1', '0,2'), ('show 1', '0,1,2'), ('hide the last', '0'), ('carried', '0,2'), ('not carried', '0,1,2,3')) as x(step, shown)")
def visible_columns(spark, sf_dir):
    steps = [
        ("hide 1", rules.visible_columns([0, 1, 2], 1, False, 3)), ("show 1", rules.visible_columns([0, 2], 1, True, 3)), ("hide the last", rules.visible_columns([0], 0, False, 3)),
        ("carried", rules.carried_columns([0, 2], 3, 3)), ("not carried", rules.carried_columns([0, 2], 3, 4)),
    ]
    return told(spark, [(name, ",".join(map(str, shown))) for name, shown in steps], "step string, shown string")


@query("select format('{:,} of {:,} rows', (select count(*) from orders where o_totalprice >= 250000), (select count(*) from orders)) as exact, format('{:,} of ~{:,} rows (50%)', (select count(*) from orders where o_totalprice >= 250000), (select count(*) from orders)) as partly")
def filter_banner(spark, sf_dir):
    t = opened(spark, sf_dir, "orders")
    n, total = t.where(request(t, Mode.GE, "250000", "o_totalprice")).count(), t.count()
    return told(spark, [(str(rules.Banner(n, total)), str(rules.Banner(n, total, True, 0.5)))], "exact string, partly string")


@query("select * from (values ('SHIP', 'l_shipdate', false), ('key', 'l_orderkey,l_partkey,l_suppkey', false), ('l_', 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus', true), ('#3', 'l_suppkey', false), ('#03', '', false), ('#12', '', false)) as x(typed, found, more)")
def label_search(spark, sf_dir):
    labels = opened(spark, sf_dir, "lineitem").spec.labels
    rows = []
    for typed in ("SHIP", "key", "l_", "#3", "#03", "#12"):
        found, more = search_labels(labels, typed)
        rows.append((typed, ",".join(labels[k] for k in found), more))
    return told(spark, rows, "typed string, found string, more boolean")


@query("select * from (values ('text', 'leading'), ('boolean', 'center'), ('integer', 'trailing'), ('decimal', 'trailing'), ('date', 'trailing'), ('datetime', 'trailing')) as x(kind, alignment)")
def alignments(spark, sf_dir):
    return told(spark, [(k.value, alignment(k).value) for k in (Kind.TEXT, Kind.BOOLEAN, Kind.INTEGER, Kind.DECIMAL, Kind.DATE, Kind.DATETIME)], "kind string, alignment string")


@query("select * from (values ('12', '3.25', 'decimal', 4, 2), ('1e3', '0.5', 'decimal', 5, 1), ('100', '7', 'integer', 3, 0), ('true', '1', 'text', null, null), ('2024-01-01T00:00:00', '2024-01-01T00:00:00Z', 'text', null, null), ('2024-01-01', '2024-01-02', 'date', null, null)) as x(a, b, kind, precision, scale)")
def type_join(spark, sf_dir):
    pairs = [("12", "3.25"), ("1e3", "0.5"), ("100", "7"), ("true", "1"), ("2024-01-01T00:00:00", "2024-01-01T00:00:00Z"), ("2024-01-01", "2024-01-02")]
    types = [(a, b, joined(type_of(a), type_of(b))) for a, b in pairs]
    return told(spark, [(a, b, t.kind.value, t.precision, t.scale) for a, b, t in types], "a string, b string, kind string, precision long, scale long")


@query("select * from (values ('header', 2, true), ('header', 3, false), ('separator, equal labels', 2, true), ('separator, other labels', 2, false)) as x(change, columns, kept)")
def reopen_settings(spark, sf_dir):
    spec = lambda *labels: TableSpec("t", labels, None)
    a = spec("x", "y")
    rows = [
        ("header", 2, keeps_settings(a, spec(None, None), True)), ("header", 3, keeps_settings(a, spec(None, None, None), True)),
        ("separator, equal labels", 2, keeps_settings(a, spec("x", "y"), False)), ("separator, other labels", 2, keeps_settings(a, spec("x", "z"), False)),
    ]
    return told(spark, rows, "change string, columns int, kept boolean")


@query("select 'beyond' as jump, null::bigint as submitted, null::boolean as reached union all select 'within', 5, true union all select 'filtered', (select count(*) from orders), true union all select 'short', null, false")
def jump_submit(spark, sf_dir):
    """A jump that can't land is refused; under a filter it lands on what is kept."""
    n = opened(spark, sf_dir, "orders").count()
    rows = [
        ("beyond", rules.submit_jump(n, n, True, False), None), ("within", rules.submit_jump(5, n, True, False), rules.resolve_jump(5, 5, False)),
        ("filtered", rules.submit_jump(n, n, True, True), rules.resolve_jump(n, 3, True)), ("short", None, rules.resolve_jump(n, n - 1, False)),
    ]
    return told(spark, rows, "jump string, submitted long, reached boolean")


@query("select * from (values ('empty text', false, null), ('no number', false, null), ('all columns', true, null), ('some columns', true, '0,2')) as x(find, submitted, scope)")
def find_submit(spark, sf_dir):
    asked = [
        ("empty text", rules.find_request("", Mode.TEXT, None, [0, 1], 3)), ("no number", rules.find_request("abc", Mode.LT, 1, [0], 3)),
        ("all columns", rules.find_request("x", Mode.TEXT, None, [2, 0, 1], 3)), ("some columns", rules.find_request("x", Mode.TEXT, None, [2, 0], 3)),
    ]
    return told(spark, [(name, r is not None, ",".join(map(str, r.scope)) if r and r.scope else None) for name, r in asked], "find string, submitted boolean, scope string")


@query("select * from (values ('nothing there', 'no matches', null), ('from the end', 'continued from the start', 'found'), ('from the start', 'continued from the end', 'found'), ('ahead', 'none', 'found')) as x(find, notice, state)")
def wrap_notices(spark, sf_dir):
    """The markets of customers: found ahead, or by going on at the other end."""
    t = opened(spark, sf_dir, "customer")
    rows, n = [], t.count()
    for name, value, forward, anchor in (("nothing there", "no such market", True, 0), ("from the end", "building", True, n), ("from the start", "building", False, 0), ("ahead", "building", True, 0)):
        find = t.view().find(request(t, Mode.EQ, value, "c_mktsegment"))
        hit, wrapped = find.wrapped(forward, anchor)
        rows.append((name, rules.notice(hit, wrapped, forward, find.total).value, hit.state.value if hit.state is Found.FOUND else None))
    return told(spark, rows, "find string, notice string, state string")


@query("select 'complete' as budget, 'complete' as outcome, count(*) as rows from nation union all select 'cells', 'stopped at the cell cap', 3 union all select 'bytes', 'stopped at the byte budget', 0")
def copy_outcomes(spark, sf_dir):
    t = opened(spark, sf_dir, "nation")
    n, rows = t.count(), []
    for name, budget in (("complete", {}), ("cells", {"max_cells": 7}), ("bytes", {"max_bytes": 3})):
        got = t.view().copy(0, n, [0, 1], **budget)
        rows.append((name, rules.copy_outcome(got, n, budget.get("max_bytes")).value, got.rows))
    return told(spark, rows, "budget string, outcome string, rows long")


@query("select 'count' as job, 'done' as state, count(*) as result from orders union all select 'sort', 'done', count(*) from orders union all select 'find', 'done', count(*) filter (o_orderpriority = '5-LOW') from orders union all select 'infer', 'done', 6 union all select 'jump', 'done', least(700, count(*) - 1) from orders union all select 'failing', 'failed', null")
def job_states(spark, sf_dir):
    """Actions on threads of their own end done or failed, with their result."""
    t = opened(spark, sf_dir, "orders")
    actions = {
        "count": t.rows.count,
        "sort": lambda: t.order_by(at(t, "o_totalprice")).numbered.count(),
        "find": lambda: t.view().find(request(t, Mode.EQ, "5-low", "o_orderpriority")).total,
        "infer": lambda: len(t.columns.infer(range(6))),
        "jump": lambda: t.view().jump(700),
        "failing": lambda: 1 // 0,
    }
    states = {name: Job(spark, f).wait(600) for name, f in actions.items()}
    return told(spark, [(name, s.state.value, s.result) for name, s in states.items()], "job string, state string, result long")
