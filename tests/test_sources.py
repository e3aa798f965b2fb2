"""Delimited text and Parquet: detection, lexing, splits, fallbacks, footers."""

import gzip
import random
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tabulon.errors import InvalidArgument, NotFound, ReadFailed, UnsupportedSchema
from tabulon.sources import delimited, encoding, parquet
from tabulon.sources.lexer import records
from tabulon.sources.sniff import sniff
from tabulon.spec import Kind, OpenOptions, Zone
from tabulon.table import estimated_rows, open_table, probe


def cells(table):
    rows = table.rows.orderBy("source_row").collect()
    assert [r["source_row"] for r in rows] == list(range(len(rows)))
    return [[r[f"c{k}"] for k in range(table.spec.column_count)] for r in rows]


def made(tmp_path, data, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def lexed(text, separator=",", quote='"', sizes=(10**9, 1, 3)):
    """The same by any cut of the text."""
    out = []
    for n in sizes:
        out.append([f for f, _, _ in records((text[k : k + n] for k in range(0, len(text), n)), separator, quote)])
    assert all(o == out[0] for o in out), out
    return out[0]


LEXED = {
    "": [],
    "a": [["a"]],
    "a,b\n": [["a", "b"]],
    "a\r\nb\rc\n": [["a"], ["b"], ["c"]],
    "a\n\nb": [["a"], [""], ["b"]],
    '"x"junk,y': [["xjunk", "y"]],
    'a"b"c,"d""e"': [['a"b"c', 'd"e']],
    '"a,b\nc",d\ne,f': [["a,b\nc", "d"], ["e", "f"]],
    '"open\nto the end,x': [["open\nto the end,x"]],
    ',,\n"",': [["", "", ""], ["", ""]],
    '"a"""': [['a"']],
    "\n": [[""]],
    ' "a",b': [[' "a"', "b"]],
}


@pytest.mark.parametrize("text", LEXED)
def test_lexer(text):
    assert lexed(text) == LEXED[text]


def test_lexer_without_quotes():
    assert lexed('"a,b"\n', quote="") == [['"a', 'b"']]


def by_characters(text, separator, quote):
    """Another lexer, character by character."""
    out, fields, field, k, start = [], [], "", 0, True
    if not text:
        return out
    ended = False
    while k < len(text):
        ended = False
        c = text[k]
        if start and quote and c == quote:
            k += 1
            while k < len(text):
                if text[k] == quote:
                    if text[k + 1 : k + 2] == quote:
                        field, k = field + quote, k + 2
                        continue
                    k += 1
                    break
                field, k = field + text[k], k + 1
            start = False
            continue
        start = False
        if c == separator:
            fields, field, start = [*fields, field], "", True
        elif c in "\r\n":
            if text[k : k + 2] == "\r\n":
                k += 1
            out.append([*fields, field])
            fields, field, start, ended = [], "", True, True
        else:
            field += c
        k += 1
    return out if ended else [*out, [*fields, field]]


def test_lexer_differential():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice('ab,"\n\r;\' ') for _ in range(rng.randrange(14)))
        for separator, quote in ((",", '"'), (";", "'"), (",", "")):
            assert lexed(text, separator, quote, (10**9, 1, 2)) == by_characters(text, separator, quote), (text, separator, quote)


@pytest.mark.parametrize(
    ("sample", "options", "want"),
    [
        ("a,b\n1,2\n", {}, (",", '"')),
        ("a;b\n1;2\n", {}, (";", '"')),
        ("a\tb\n1\t2\n", {}, ("\t", '"')),
        ("a|b\n1|2\n", {}, ("|", '"')),
        ("'a,b',c\n'd',e\n", {}, (",", "'")),
        ("a,b;c\n", {"separator": ";"}, (";", '"')),
        ("a\n", {}, (",", '"')),
        ("", {"quote": ""}, (",", "")),
        ("a,b\n", {"quote": ","}, (";", ",")),
    ],
)
def test_sniff(sample, options, want):
    assert sniff(sample, OpenOptions(**options)) == want


def test_options_are_checked():
    for bad in ({"separator": "é"}, {"separator": "\n"}, {"quote": "ab"}, {"separator": ",", "quote": ","}, {"encoding": "koi8"}):
        with pytest.raises(InvalidArgument):
            OpenOptions(**bad)
    assert OpenOptions(separator=";").changed(quote="'") == OpenOptions(separator=";", quote="'")


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (b"\xef\xbb\xbfa", ("utf-8", 3)), (b"\xff\xfea\0", ("utf-16-le", 2)), (b"\xfe\xff\0a", ("utf-16-be", 2)), ("abcdef".encode("utf-16-le"), ("utf-16-le", 0)),
        ("abcdef".encode("utf-16-be"), ("utf-16-be", 0)), ("é".encode(), ("utf-8", 0)), ("é".encode()[:1], ("utf-8", 0)), (b"caf\xe9,x", ("latin-1", 0)), (b"", ("utf-8", 0)),
    ],
)
def test_encodings(raw, want):
    assert encoding.resolve(raw) == want


def test_open_encodings(spark, tmp_path):
    text = "name,city\nJosé,東京😀\n\"a\nb\",c\n"
    for name, data in (("u8", text.encode()), ("bom", b"\xef\xbb\xbf" + text.encode()), ("le", b"\xff\xfe" + text.encode("utf-16-le")), ("be", text.encode("utf-16-be"))):
        t = open_table(spark, made(tmp_path, data, name), OpenOptions(encoding="utf-16-be") if name == "be" else OpenOptions())
        assert (t.spec.labels, cells(t)) == (("name", "city"), [["José", "東京😀"], ["a\nb", "c"]]), name
    t = open_table(spark, made(tmp_path, b"id,price\n1,\x80\x81\n"), OpenOptions(encoding="windows-1252"))
    assert cells(t) == [["1", "€�"]]
    assert cells(open_table(spark, made(tmp_path, b"a,b\ncaf\xe9,x\n"))) == [["café", "x"]]


def test_shapes(spark, tmp_path):
    shape = lambda data, **o: (lambda t: (t.spec.labels, cells(t)))(open_table(spark, made(tmp_path, data), OpenOptions(**o)))
    assert shape("a,b,c\n1,2\n5,6,7,8\n") == (("a", "b", "c"), [["1", "2", ""], ["5", "6", "7"]])
    assert shape("1,2.5\n3,4\n") == ((None, None), [["1", "2.5"], ["3", "4"]])
    assert shape("1,2.5\n3,4\n", header=True) == (("1", "2.5"), [["3", "4"]])
    assert shape("a,b\n", header=False) == ((None, None), [["a", "b"]])
    assert shape("a,a,\n1,2,3") == (("a", "a", None), [["1", "2", "3"]])
    assert shape("") == ((), [])
    assert shape("h\n\nx\n") == (("h",), [[""], ["x"]])


def test_gzip(spark, tmp_path):
    text = "name,n\n" + "".join(f"x{k},{k}\n" for k in range(2000))
    half = len(text) // 2
    whole = gzip.compress(text[:half].encode()) + gzip.compress(text[half:].encode())
    for name, data, n in (("a.csv", whole, 2000), ("junk", whole + b"xyz", 2000)):
        t = open_table(spark, made(tmp_path, data, name))
        assert t.spec.gzip and t.count() == n
    cut = open_table(spark, made(tmp_path, whole[: len(whole) * 3 // 4], "cut"))
    assert 1000 <= cut.count() < 2000 and cells(cut)[:2] == [["x0", "0"], ["x1", "1"]]


@pytest.mark.parametrize("seed", range(4))
def test_splits_agree_with_one_pass(spark, tmp_path, seed):
    """Quoted line ends anywhere: the splits give the rows and source rows of a sequential reading."""
    rng = random.Random(seed)
    cell = lambda: rng.choice(["a", "", '"x\ny"', '"say ""hi""\n\n,"', "b c", '"\n"', 'q"uote'])
    text = "id,a,b\n" + "".join(f"{k},{cell()},{cell()}\n" for k in range(300)) + rng.choice(["", '"open\nend'])
    spec = probe(made(tmp_path, text))
    whole = [f for f, _, _ in records([text], ",", '"')][1:]
    found = delimited.splits(spark, spec, 256)
    assert len(found) > 3
    rows = delimited.load(spark, spec, step=256).orderBy("source_row").collect()
    assert [r["source_row"] for r in rows] == list(range(len(whole)))
    assert [[r["c0"], r["c1"], r["c2"]] for r in rows] == [(f + ["", ""])[:3] for f in whole]


def test_windows_read_a_part(spark, tmp_path, monkeypatch):
    """The first rows without finding splits; later ones from the splits that hold them; Parquet by its row groups."""
    monkeypatch.setattr(delimited, "NEAR_ROWS", 50)
    path = made(tmp_path, "k,t\n" + "".join(f'{k},"a\nb"\n' for k in range(400)))
    t = open_table(spark, path)
    assert [r["c0"] for r in t.view().window(10, 5, [0]).orderBy("view_row").collect()] == ["10", "11", "12", "13", "14"] and not t.spec.extra
    spec = probe(path)
    delimited.known_splits(spark, spec, 512)
    some = delimited.load(spark, spec, [1, 0], 512, (200, 203))
    assert some.rdd.getNumPartitions() < 3 and [tuple(r) for r in some.select("source_row", "c0", "c1").orderBy("source_row").collect()] == [(k, str(k), "a\nb") for k in range(200, 203)]
    pq.write_table(pa.table({"a": range(100), "b": [f"x{k}" for k in range(100)]}), str(tmp_path / "w.parquet"), row_group_size=10)
    w = open_table(spark, str(tmp_path / "w.parquet")).view().window(35, 10, [1])
    assert w.rdd.getNumPartitions() == 2 and [tuple(r) for r in w.orderBy("view_row").collect()] == [(k, k, f"x{k}") for k in range(35, 45)]
    assert open_table(spark, str(tmp_path / "w.parquet")).view().window(95, 10).count() == 5 and t.view().window(398, 9).count() == 2


def test_open_errors(spark, tmp_path):
    with pytest.raises(NotFound):
        open_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ReadFailed):
        open_table(spark, str(tmp_path))


def test_estimate():
    assert (estimated_rows(100, 5, 50), estimated_rows(100, 0, 0), estimated_rows(0, 0, 0), estimated_rows(100, 7, 100)) == (10, 1, 0, 7)


def parquet_table(n=8):
    import datetime as d

    return pa.table(
        {
            "id": pa.array(range(n), pa.int64()),
            "name": pa.array(["x", None, "", 'q"', "l\nn", "日本", "A", "b"][:n]),
            "score": pa.array([1.5, -2.0, None, 7.25, 0.0, 1e20, -0.5, 3.0][:n]),
            "flag": pa.array([True, False, None] * 2 + [True, False]),
            "day": pa.array([d.date(2024, 2, 29)] * n),
            "stamp": pa.array([d.datetime(2024, 1, 2, 3, 4, 5, 678901)] * n, pa.timestamp("us", "UTC")),
            "amount": pa.array([Decimal("-0.0012"), Decimal("0"), None, Decimal("12345.6789")] * 2, pa.decimal128(20, 4)),
            "big": pa.array([18446744073709551615] * n, pa.uint64()),
        }
    )


WANT = ["0", "x", "1.5", "true", "2024-02-29", "2024-01-02T03:04:05.678901000Z", "-0.0012", "18446744073709551615"]


@pytest.mark.parametrize("codec", ["none", "snappy", "zstd", "gzip", "brotli", "lz4"])
@pytest.mark.parametrize("version", ["1.0", "2.0"])
def test_parquet_codecs(spark, tmp_path, codec, version):
    path = str(tmp_path / "t.parquet")
    pq.write_table(parquet_table(), path, compression=codec, data_page_version=version, row_group_size=4)
    t = open_table(spark, path)
    got = cells(t)
    assert got[0] == WANT and got[1][1] == "" and got[1][2] == "-2" and got[1][6] == "0.0000" and got[2][2] == "" and got[5][2] == "100000000000000000000" and t.count() == 8
    assert [x.kind for x in t.spec.declared] == [Kind.INTEGER, Kind.TEXT, Kind.DECIMAL, Kind.BOOLEAN, Kind.DATE, Kind.DATETIME, Kind.DECIMAL, Kind.INTEGER]
    assert t.spec.declared[5].zone is Zone.ZONED


def test_parquet_fallback(spark, tmp_path):
    import datetime as d

    path = str(tmp_path / "odd.parquet")
    odd = pa.table(
        [
            pa.array([d.time(1, 2, 3, 4), None], pa.time64("us")), pa.array([1, 2], pa.int32()), pa.array([1704164645000000001, None], pa.timestamp("ns")),
            pa.array([Decimal("9" * 50 + ".5"), Decimal("-0.5")], pa.decimal256(60, 1)), pa.array([0.1, 2.0], pa.float32()),
        ],
        names=["t", "a", "n", "d", "A"],
    )
    pq.write_table(odd, path, row_group_size=1)
    t = open_table(spark, path)
    assert t.spec.labels == ("t", "a", "n", "d", "A") and t.kinds == ()
    assert cells(t) == [["01:02:03.000004000", "1", "2024-01-02T03:04:05.000000001", "9" * 50 + ".5", "0.1"], ["", "2", "", "-0.5", "2"]]


def test_parquet_nested_is_refused(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    pq.write_table(pa.table({"x": [[1], [2]]}), path)
    with pytest.raises(UnsupportedSchema):
        open_table(spark, path)


def test_parquet_typed_predicates_agree_with_text(spark, tmp_path):
    from tabulon.plans import predicate
    from tabulon.spec import Mode, SearchRequest

    path = str(tmp_path / "p.parquet")
    pq.write_table(parquet_table(), path)
    t = open_table(spark, path)
    for column in (0, 2, 6, 7):
        for mode in (Mode.LT, Mode.LE, Mode.GT, Mode.GE, Mode.EQ, Mode.NE):
            for value in ("0", "1.5", "-2", "3e0", "-0.0012", "1e30", "18446744073709551615"):
                r = SearchRequest(mode, value, column).normalized(8)
                want = t.rows.where(predicate.matches(r, t.cells)).count()
                assert t.where(r).count() == want, r
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in t.where(SearchRequest(Mode.GT, "3", 0)).numbered._jdf.queryExecution().toString()


def test_folder_of_parquet(spark, tmp_path):
    for k in range(3):
        (tmp_path / "d").mkdir(exist_ok=True)
        pq.write_table(pa.table({"x": range(k * 10, k * 10 + 10)}), str(tmp_path / "d" / f"part-{k}.parquet"))
    t = open_table(spark, str(tmp_path / "d"))
    assert cells(t) == [[str(k)] for k in range(30)]


def test_footer(tmp_path):
    path = str(tmp_path / "f.parquet")
    pq.write_table(parquet_table(), path, compression={"id": "zstd", "name": "snappy"}, row_group_size=5)
    info = parquet.file_info(path)
    assert (info.rows, info.row_groups, info.columns) == (8, 2, 8) and {"ZSTD", "SNAPPY"} <= set(info.codecs) and info.codec_mask & (1 << 1) and info.codec_mask & (1 << 6)
    assert [(g.first_row, g.rows) for g in parquet.row_groups(path)] == [(0, 5), (5, 3)]
    columns = parquet.column_info(path)
    assert columns[0].physical == "INT64" and "Decimal" in columns[6].logical and columns[0].nullable
