"""The reject-separating loader against a hand-written record grammar."""

from hypothesis import given, settings
from hypothesis import strategies as st

from senarai.operators import rejects

CASES = {
    'a,positif,0.5': None, '"a, b",negatif,"-0.5"': None, '"a ""q"" b",netral, .5 ': None, '"two\nlines",positif,+1e-1': None,
    'a,positif,1.': None, '"a,positif,0.5': "quoting", '"a"b,positif,1': "quoting", 'a "b",positif,1': "quoting", ' "a",positif,1': "quoting",
    'a;positif;0.5': "columns", 'a,positif': "columns", 'a,positif,1,': "columns", '': "columns", ' ,positif,1': "value",
    '"",positif,1': "value", 'a,Positif,1': "value", 'a, positif,1': "value", 'a,positif,1.5': "value", 'a,positif,nan': "value", 'a,positif,1_0': "value",
    'a,positif,０.５': "value", 'a,positif,': "value", 'a,positif,0x1': "value", 'a,positif,"0,5"': "value", 'a\nb,positif,1': None, 'a,positif,--1': "value",
    '　,positif,1': "value", 'a,positif,-1e0': None, 'a,positif,1e400': "value", 'a\\,positif,1': None, '"a\\"",positif,1': "quoting",
}


def grammar(line: str):
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, part = i + 1, ""
            while True:
                k = line.find('"', j)
                if k < 0:
                    return None
                if line[k + 1 : k + 2] == '"':
                    part += line[j : k + 1]
                    j = k + 2
                    continue
                part += line[j:k]
                break
            i = k + 1
            if line[i : i + 1] not in ("", ","):
                return None
            fields.append(part)
        else:
            k = line.find(",", i)
            k = len(line) if k < 0 else k
            if '"' in line[i:k]:
                return None
            fields.append(line[i:k])
            i = k
        if i >= len(line):
            return fields
        i += 1


def test_reasons(spark):
    df = spark.createDataFrame([(i, line, "clash") for i, line in enumerate([*CASES, None])], "id bigint, line string, reason string")
    got = {r.line_id: r for r in rejects.classify_lines(df, "id", "line").collect()}
    assert len(got) == len(CASES)
    for i, (line, reason) in enumerate(CASES.items()):
        assert got[i].reason == reason, line
        if reason is None:
            fields = grammar(line)
            assert (got[i].ulasan, got[i].sentiment, got[i].confidence) == (fields[0], fields[1], float(fields[2]))
    assert rejects.classify_lines(df.limit(0), "id", "line").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab",\n\r é', max_size=12))
def test_quoting_is_the_grammar(line):
    assert rejects.well_quoted(line) == (grammar(line) is not None)


def test_fields_are_the_grammar():
    lines = ['a,positif,1', 'a\r\nb,positif,1', '"a\r\n""x""",netral,0', 'x' * 3_000_000 + ",positif,1", "a,b,c,d", ",,"]
    got = rejects.read_records(lines)
    assert [got[i][3] for i in range(len(lines))] == [None, None, None, None, "columns", "value"]
    assert got[1][0] == "a\r\nb" and got[2][0] == 'a\r\n"x"' and len(got[3][0]) == 3_000_000


def test_report(spark):
    df = spark.createDataFrame([(1, 7, "a,positif,1"), (2, 7, "a"), (3, 8, "a,b,1")], "id bigint, f bigint, line string")
    assert sorted(tuple(r) for r in rejects.reject_report(df, "id", "line", "f").collect()) == [(7, "columns", 1), (7, "loaded", 1), (8, "value", 1)]
