"""CSV records cut from splits against a plain reading of whole files."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contactscope.sources import csv_splits
from contactscope.sources.csv_splits import records
from contactscope.sources.tables import malformed_rows, read_table
from pyspark.sql import types as T


def plain(text: str) -> list[str]:
    """Records by one character after the other."""
    out, record, state = [], "", "begin"
    for c in text:
        if state == "quote" and c != '"':  # the quote before closed the cell
            state = "cell"
        if c == "\n" and state != "inside":
            out.append(record)
            record, state = "", "begin"
            continue
        record += c
        if state == "inside":
            state = "quote" if c == '"' else state
        elif state == "quote":
            state = "inside"
        elif c == ",":
            state = "begin"
        else:
            state = "inside" if state == "begin" and c == '"' else "cell"
    out.append(record)
    out = [r.removesuffix("\r") for r in out]
    return [r for r in out if r]


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of a line is inside a quoted cell."""
    state = "inside" if inside else "begin"
    for c in line:
        if state == "quote" and c != '"':
            state = "cell"
        if state == "inside":
            state = "quote" if c == '"' else state
        elif state == "quote":
            state = "inside"
        elif c == ",":
            state = "begin"
        else:
            state = "inside" if state == "begin" and c == '"' else "cell"
    return state == "inside"


def written(folder, *texts):
    folder.mkdir(exist_ok=True)
    for i, text in enumerate(texts):
        (folder / f"f{i}.csv").write_bytes(text.encode())
    return f"file://{folder}"


@pytest.fixture
def small_splits(spark):
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = [spark.conf.get(name) for name in names]

    def put(size, batch=10_000):
        for name, value in zip(names, (size, batch), strict=True):
            spark.conf.set(name, value)

    yield put
    put(*old)


def hard_text(draw, rows, odd=True):
    cells = ["a", "", "bc", '"q"', '"a,b"', '"two\nlines"', '"x""y\n""\n,z"', '"\r\n"', '"' + "long\n" * 30 + '"']
    if odd:
        cells += ['5" pipe', '"a"b', ' "c', 'x"', 'd"",e"']
    return "".join(",".join(draw.choices(cells, k=draw.randrange(1, 5))) + draw.choice(["\n", "\r\n"]) for _ in range(rows))


@pytest.mark.parametrize("size", [7, 64, 1000])
@pytest.mark.parametrize("odd", [False, True])
def test_equals_plain_reading(spark, tmp_path, small_splits, size, odd):
    draw = random.Random(size)
    texts = [hard_text(draw, n, odd) for n in (60, 1, 25)]
    texts += ["", "\n\n", "h", '"never closed,\na\n\nb', '"a\nb', "a\n\n\"\n\n\"\n\nb", "x" * 200 + "\n" + "y\n" * 20]
    path = written(tmp_path / "t", *texts)
    small_splits(size, batch=size % 10 + 1)
    want = [r for t in texts for r in plain(t)]
    got = [r.value for r in records(spark, path, header=False).collect()]
    assert sorted(got) == sorted(want)
    # Without headers: the first record of each file goes. An empty first line counts as one.
    want = [r for t in texts for r in plain(t)[0 if t.startswith("\n") else 1 :]]
    assert sorted(r.value for r in records(spark, path).collect()) == sorted(want)


def test_rows_are_those_of_a_reader_of_whole_files(spark, tmp_path, small_splits):
    draw = random.Random(2)
    rows = "".join(
        ",".join([str(i), draw.choice(['"a\nb"', "c", '"d "" e"', "", '"x,\n\n,y"']), draw.choice(["é", '"\n"'])]) + "\n"
        for i in range(500)
    )
    path = written(tmp_path / "t", "id,some text,Other\n" + rows)
    kinds = T.StructType([T.StructField("id", T.LongType()), T.StructField("other", T.StringType()),
                          T.StructField("some text", T.StringType())])
    whole = spark.read.option("quote", '"').option("escape", '"').option("multiLine", True).option("header", True).csv(path)
    small_splits(200)
    table = read_table(spark, path, kinds, "csv")
    assert table.rdd.getNumPartitions() > 10
    want = sorted((int(r["id"]), r["Other"], r["some text"]) for r in whole.collect())
    assert sorted(tuple(r) for r in table.collect()) == want
    assert malformed_rows(spark, path).first().asDict()["malformed"] == 0


def test_header_across_splits(spark, tmp_path, small_splits):
    path = written(tmp_path / "t", 'id,"a\nlong\nheader\nof\nmany\nlines"\n1,x\n2,"y\nz"\n')
    small_splits(8)
    assert sorted(r.value for r in records(spark, path).collect()) == ["1,x", '2,"y\nz"']


def test_one_file_is_many_tasks(spark, tmp_path, small_splits):
    text = "id,note\n" + "".join(f'{i},"line\nand line {i}"\n' for i in range(200_000))
    path = written(tmp_path / "t", text)
    small_splits(256 << 10)
    out = records(spark, path)
    assert out.rdd.getNumPartitions() >= len(text) // (300 << 10)
    assert out.distinct().count() == 200_000


def test_a_cell_that_is_too_long_is_told(spark, tmp_path, monkeypatch):
    path = written(tmp_path / "t", 'a,b\n1,"never closed\n' + "text\n" * 1000)
    monkeypatch.setattr(csv_splits, "MAX_RECORD", 1000)
    with pytest.raises(Exception, match="ever closed"):
        records(spark, path).collect()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('ab,"', max_size=12), max_size=6))
def test_states_of_lines(lines):
    """Steps of whole arrays and their composition against one line after the other."""
    array = pa.array(lines, pa.string())
    for begins in (False, True):
        states = [begins]
        for line in lines:
            states.append(ends_inside(line, states[-1]))
        assert csv_splits._states(*csv_splits._steps(array), begins).tolist() == states
