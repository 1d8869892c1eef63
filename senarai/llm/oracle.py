"""SQL equivalents (DuckDB) of the queries that SQL can express on whole tables."""

from __future__ import annotations

from .formcopies import FIELD_LABELS


def _terms(src: str, key: str, text: str) -> str:
    return f"""SELECT row_id, unnest(list_transform(regexp_extract_all(t, '\\p{{L}}+'), lambda x: lower(x))) AS term
               FROM (SELECT {key} AS row_id, {text} AS t FROM {src} WHERE {text} IS NOT NULL)"""


def _tf(src: str, key: str, text: str) -> str:
    return f"""SELECT row_id, term, count(*) AS tf FROM ({_terms(src, key, text)}) GROUP BY ALL"""


def _p2(src: str, key: str, text: str) -> str:
    return f"""SELECT '{src}' AS src, p.row_id, p.term
               FROM ({_tf(src, key, text)}) p JOIN (SELECT term, count(*) AS df FROM ({_tf(src, key, text)}) GROUP BY term) s USING (term)
               WHERE tf >= 3 AND df BETWEEN 2 AND 20"""


def _p2_scores(src: str, key: str, text: str) -> str:
    return f"""WITH p AS ({_tf(src, key, text)}), s AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term),
                    n AS (SELECT count(*)::DOUBLE AS n FROM {src} WHERE {text} IS NOT NULL),
                    r AS (SELECT term, df, cf, round(-log2(df / n) + log2(1 - exp(-cf / n)), 6) + 0.0 AS ridf FROM s, n)
               SELECT row_id, term, tf::INT AS tf, df, cf, ridf, round(tf * ridf, 6) + 0.0 AS score FROM p JOIN r USING (term)"""


def _p7(src: str, key: str, text: str) -> str:
    return f"""SELECT '{src}' AS src, term, sum(tf)::BIGINT AS cf, count(*) AS df,
                      CASE WHEN count(*) <= 2 THEN 'rare' WHEN count(*) > 0.1 * (SELECT count(*) FROM {src} WHERE {text} IS NOT NULL) THEN 'common' END AS mark
               FROM ({_tf(src, key, text)}) GROUP BY term"""


def _form_keys(src: str, text: str, labelled: bool) -> str:
    strip = lambda x: f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    plain = strip(text)
    if labelled:
        labels = "|".join(FIELD_LABELS)
        parts = f"string_split(regexp_replace({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}])((?:{labels})\\s*[:：])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
        canon = f"""CASE WHEN len({parts}) > 2 THEN array_to_string(list_sort(list_filter(list_transform({parts}, lambda x: {strip("x")}), lambda x: x <> '')), chr(10)) ELSE {plain} END"""
    else:
        canon = plain
    return f"""SELECT row_id, {strip("user_name")} || chr(0) || {canon} AS k FROM {src}
               WHERE user_name IS NOT NULL AND {text} IS NOT NULL AND {plain} <> ''"""


def _p3(src: str, text: str, labelled: bool) -> str:
    return f"""SELECT '{src}' AS src, keep_id, row_id FROM (SELECT min(row_id) OVER (PARTITION BY k) AS keep_id, row_id FROM ({_form_keys(src, text, labelled)}))
               WHERE row_id > keep_id"""


def _p3_copies(src: str, text: str, labelled: bool) -> str:
    return f"""SELECT '{src}' AS src, min(row_id) AS keep_id, count(*) AS copies FROM ({_form_keys(src, text, labelled)}) GROUP BY k HAVING count(*) > 1"""


def _p5() -> str:
    words = """(SELECT DISTINCT row_id, split = 'train' AS t, unnest(list_transform(regexp_extract_all(raw, '[\\p{L}\\p{N}]+'), lambda x: lower(x))) AS w
                FROM labelled WHERE raw IS NOT NULL AND split IN ('train', 'valid', 'test'))"""
    return f"""WITH w AS MATERIALIZED {words}, n AS MATERIALIZED (SELECT row_id, t, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 25),
                    k AS MATERIALIZED (SELECT w.row_id, w.t, w.w, n.n FROM w JOIN n USING (row_id))
               SELECT least(a.row_id, b.row_id) AS row_a, greatest(a.row_id, b.row_id) AS row_b FROM k a JOIN k b ON a.w = b.w AND a.t AND NOT b.t
               GROUP BY a.row_id, b.row_id, a.n, b.n HAVING count(*) >= 0.75 * (a.n + b.n - count(*))"""


def _p5_counts() -> str:
    return f"""SELECT split, source, count(*) AS n_records, count(hit) AS n_overlapping
               FROM labelled LEFT JOIN (SELECT DISTINCT unnest([row_a, row_b]) AS hit FROM ({_p5()})) ON hit = row_id
               WHERE split IN ('valid', 'test') GROUP BY ALL"""


_P9_RUN = 12


def _runs(src: str, key: str, text: str) -> str:
    """key, i, run: every run of _P9_RUN words of a text and the number of its first word."""
    return f"""(SELECT {key}, i, array_to_string(w[i:i + {_P9_RUN - 1}], ' ') AS run FROM
        (SELECT {key}, w, unnest(range(1, len(w) - {_P9_RUN - 2})) AS i FROM
          (SELECT {key}, list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)) AS w FROM {src} WHERE {text} IS NOT NULL)))"""


def _hits() -> str:
    items = f"(SELECT DISTINCT item_id, run FROM {_runs('benchmark_items', 'item_id', 'passage')})"
    return f"(SELECT DISTINCT doc_id, item_id, i FROM {_runs('documents', 'doc_id', 'text')} JOIN {items} USING (run))"


def _p9_spans() -> str:
    """Neighbouring runs are one span; its offsets are the lengths of the words and separators before."""
    spans = f"""(SELECT doc_id, item_id, min(i) AS a, max(i) + {_P9_RUN - 1} AS b FROM
        (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY i) AS island FROM {_hits()}) GROUP BY doc_id, item_id, island)"""
    place = lambda k: f"CASE WHEN regexp_matches(t[1], '^[\\p{{L}}\\p{{N}}]') THEN 2 * {k} - 1 ELSE 2 * {k} END"
    width = lambda end: f"length(array_to_string(t[1:{end}], ''))::INT"
    return f"""SELECT doc_id, item_id, (b - a + 1)::INT AS n_words, {width(f"({place('a')}) - 1")} AS start, {width(place('b'))} AS "end"
        FROM {spans} JOIN (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS t FROM documents) USING (doc_id)"""


def _union(*parts: str) -> str:
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


def oracle_sql() -> dict[str, str]:
    labelled, documents, reviews = ("labelled", "row_id", "raw"), ("documents", "doc_id", "text"), ("raw_reviews", "row_id", "ulasan")
    marked = _union(_p7(*labelled), _p7(*reviews))
    forms = (("raw_reviews", "ulasan", False), ("doc_example", "content", True))
    return {
        "p2_found": _union(_p2(*labelled), _p2(*documents)),
        "p2_scores": _union(*(f"SELECT '{t[0]}' AS src, * FROM ({_p2_scores(*t)})" for t in (labelled, documents))),
        "p3_found": _union(*(_p3(*f) for f in forms)),
        "p3_copies": _union(*(_p3_copies(*f) for f in forms)),
        "p9_found": f"SELECT DISTINCT doc_id, item_id FROM {_hits()}",
        "p9_spans": _p9_spans(),
        "p5_found": _p5(),
        "p5_counts": _p5_counts(),
        "p7_found": f"SELECT src, term, mark FROM ({marked}) WHERE mark IS NOT NULL",
        "p7_terms": marked,
    }
