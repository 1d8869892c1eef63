"""SQL (DuckDB) the named queries are checked against, built from the same word tables."""

from __future__ import annotations

from ..functions import lexicons as L
from ..sources import schema as S

SAMPLE_ROWS = 500
RULED_TABLES = ("raw_reviews", "doc_example", "labelled", "predictions", "upload_lines", "documents", "benchmark_items", "customer", "events")
_W = r"\p{L}\p{N}_"
_S = r"\s\x0b\x{85}\p{Z}"
_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
_EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"


def _str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_str, words)) + "]"


def _in(words) -> str:
    return "(" + ", ".join(map(_str, words)) + ")"


def _trim(x: str) -> str:
    return f"trim({x}, {_TRIM})"


# sentiment


def _sum(t: str, tables: dict) -> str:
    return " + ".join(f"({v}::DOUBLE * len(list_filter({_list(p)}, lambda k: contains({t}, k))))" for v, p in tables.items())


def _any(t: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda k: contains({t}, k))) > 0"


def _labelled(src: str, key: str, text: str, keep: str = "") -> str:
    """key, raw, sentiment, confidence of every usable row."""
    extra = f", {keep}" if keep else ""
    return f"""(SELECT {key}, raw{extra}, CASE WHEN ls >= 0.05 THEN 'positif' WHEN ls <= -0.05 THEN 'negatif' ELSE 'netral' END AS sentiment, cs AS confidence
      FROM (SELECT *, l / sqrt(l * l + 15) AS ls, c / sqrt(c * c + 15) AS cs
        FROM (SELECT *, a * f AS l, (a + m) * f AS c
          FROM (SELECT *, {_sum("t", L.VALENCES)} AS a, {_sum("t", L.SCORE_ONLY)} AS m,
                       CASE WHEN {_any("t", L.INTENSIFIERS)} THEN 1.293 ELSE 1.0 END::DOUBLE * CASE WHEN {_any("t", L.NEGATIONS)} THEN -0.74 ELSE 1.0 END::DOUBLE AS f
            FROM (SELECT {key}, {text} AS raw{extra}, lower({text}) AS t FROM {src} WHERE {_trim(f"coalesce({text}, '')")} NOT IN ('', '0'))))))"""


_REVIEWS = ("raw_reviews", "row_id", "ulasan")


def _distribution(label: str, rows: str) -> str:
    counts = ", ".join(f"count(*) FILTER ({label} = '{x}') AS {x}" for x in L.LABELS)
    pct = ", ".join(f"CASE WHEN total > 0 THEN round({x}::DOUBLE / greatest(total, 1) * 100, 1) ELSE 0.0 END AS {x}_percentage" for x in L.LABELS)
    return f"SELECT {', '.join(L.LABELS)}, total, {pct} FROM (SELECT {counts}, count(*) AS total FROM {rows})"


def _synonym(label: str) -> str:
    c = f"lower({_trim(f'coalesce({label}, {_str('')})')})"
    return f"CASE WHEN {c} IN ('positive', 'positif') THEN 'positif' WHEN {c} IN ('negative', 'negatif') THEN 'negatif' ELSE 'netral' END"


# preprocessing


def _rx(x: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({x}, {_str(pattern)}, {_str(to)}, 'g')"


def _cleanse(x: str) -> str:
    x = _rx(x, rf"https?://[^{_S}]+")
    for _ in range(2):
        x = _rx(x, rf"(^|[^{_W}])[{_W}.+-]+@[{_W}.-]+\.[a-z]{{2,}}([^{_W}]|$)", r"\1 \2")
    for _ in range(2):
        x = _rx(x, rf"(^|[^{_W}])(?:rt|via)([^{_W}]|$)", r"\1 \2")
    for pattern, to in ((rf"[@#][{_W}]+", " "), ("[\"']", " "), ("!{2,}", "!"), (r"\?{2,}", "?"), (r"\.{2,}", "."), (_EMOJI, " "), (rf"[{_S}]+", " ")):
        x = _rx(x, pattern, to)
    return _trim(x)


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {_str(rf'[{_S}]+')}), lambda x: x <> '')"


def _slang(x: str) -> str:
    table = "MAP {" + ", ".join(f"{_str(k)}: {_str(v)}" for k, v in L.SLANG.items()) + "}"
    return f"array_to_string(list_transform({_tokens(x)}, lambda x: coalesce(element_at({table}, x)[1], x)), ' ')"


def _squeeze(x: str) -> str:
    """A character equal to the one before it is dropped if the one after or two before is equal too."""
    c = f"string_split({x}, '')"
    return (
        f"array_to_string(list_transform(list_filter(range(1, len({c}) + 1), lambda i: NOT (i > 1 AND {c}[i] = {c}[i - 1] AND "
        f"((i < len({c}) AND {c}[i + 1] = {c}[i]) OR (i > 2 AND {c}[i - 2] = {c}[i])))), lambda i: {c}[i]), '')"
    )


def _stem(w: str) -> str:
    ended = f"CASE WHEN length({w}) > 5 THEN regexp_replace({w}, {_str('(?:' + '|'.join(L.SUFFIXES) + ')$')}, '') ELSE {w} END"
    begun = f"CASE WHEN length({ended}) > 6 THEN regexp_replace({ended}, {_str('^(?:' + '|'.join(L.PREFIXES) + ')')}, '') ELSE {ended} END"
    return f"CASE WHEN length({w}) < 4 OR {w} IN {_in(L.UNSTEMMED)} THEN {w} ELSE {begun} END"


def _stages(src: str, key: str, text: str, keep: str = "") -> str:
    extra = f", {keep}" if keep else ""
    return f"""(SELECT {key}{extra}, raw, case_folding, cleansing, normalisasi, array_to_string(tk, ' ') AS tokenizing, array_to_string(kt, ' ') AS filtering,
             array_to_string(list_transform(kt, lambda w: {_stem("w")}), ' ') AS stemming
      FROM (SELECT *, list_filter(tk, lambda w: length(w) > 2 AND w NOT IN {_in(L.STOPWORDS)}) AS kt
        FROM (SELECT *, {_tokens("normalisasi")} AS tk
          FROM (SELECT *, {_squeeze("slang")} AS normalisasi
            FROM (SELECT *, {_slang("cleansing")} AS slang
              FROM (SELECT *, {_cleanse("case_folding")} AS cleansing
                FROM (SELECT {key}{extra}, raw, CASE WHEN length({_trim("raw")}) < 3 THEN '' ELSE lower(raw) END AS case_folding
                  FROM (SELECT {key}{extra}, coalesce({text}, '') AS raw FROM {src})))))))) """


def _keep_first(rows: str, columns: str) -> str:
    k = f"lower({_trim('stemming')})"
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY row_id) AS rn FROM {rows} WHERE {_trim('stemming')} <> '') WHERE rn = 1"


# features

_CLEAN = f"(SELECT row_id, sentiment, {_trim(_rx(_rx('lower(raw)', rf'[^\p{{L}}{_S}]'), rf'[{_S}]+'))} AS text FROM labelled WHERE raw IS NOT NULL)"


def _words(rows: str) -> str:
    return f"(SELECT row_id, words, unnest(w) AS term FROM (SELECT row_id, len(w) AS words, w FROM (SELECT row_id, list_filter(string_split(lower(text), ' '), lambda x: trim(x) <> '') AS w FROM {rows})))"


def _df(rows: str) -> str:
    return f"(SELECT term, count(DISTINCT row_id) AS df FROM {_words(rows)} WHERE strlen(term) > 1 GROUP BY term)"


def _idf(rows: str) -> str:
    return f"(SELECT term, df, ln(((SELECT count(*) FROM {rows}) + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM {_df(rows)})"


def _tfidf(rows: str, idf: str) -> str:
    tf = f"(SELECT row_id, term, count(*)::DOUBLE / any_value(words) AS tf FROM {_words(rows)} WHERE strlen(term) > 1 GROUP BY row_id, term)"
    return f"(SELECT row_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w FROM (SELECT row_id, term, tf * idf AS w FROM {tf} JOIN {idf} USING (term)))"


# evaluation

_CELLS = f"""(SELECT row_id, lower({_trim("method_name")}) AS method, lower({_trim("coalesce(actual_label, '')")}) AS a, lower({_trim("coalesce(predicted_label, '')")}) AS p FROM predictions)"""
_CLASSES = "(SELECT unnest(['positif', 'negatif', 'netral']) AS label)"


def _class_metrics(by: str) -> str:
    """by is a column list with a trailing comma, or empty."""
    groups = (by + "label").rstrip(",")
    return f"""(SELECT *, CASE WHEN precision + recall > 0 THEN 2 * (precision * recall) / (precision + recall) ELSE 0.0 END AS f1_score
      FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall
        FROM (SELECT {groups}, count(*) FILTER (a = label AND p = label) AS tp, count(*) FILTER (a <> label AND p = label) AS fp, count(*) FILTER (a = label AND p <> label) AS fn
          FROM {_CELLS} CROSS JOIN {_CLASSES} GROUP BY {groups})))"""


def _methods() -> str:
    return f"""(SELECT method, sample_count, first_seen, correct, correct::DOUBLE / sample_count AS accuracy, precision, recall, f1_score
      FROM (SELECT method, sum(tp)::BIGINT AS correct, sum(precision) / 3 AS precision, sum(recall) / 3 AS recall, sum(f1_score) / 3 AS f1_score FROM {_class_metrics("method,")} GROUP BY method)
      JOIN (SELECT method, count(*) AS sample_count, min(row_id) AS first_seen FROM {_CELLS} GROUP BY method) USING (method))"""


def _confusion(by: str) -> str:
    groups = f"{by}actual, predicted"
    return f"""(SELECT {groups}, count(*) FILTER (a = actual AND p = predicted) AS n, count(*) AS total_samples, round(count(*) FILTER (a = actual AND p = predicted)::DOUBLE / count(*) * 100, 2) AS pct
      FROM {_CELLS} CROSS JOIN (SELECT label AS actual FROM {_CLASSES}) CROSS JOIN (SELECT label AS predicted FROM {_CLASSES}) GROUP BY {groups})"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def _report() -> str:
    f = lambda x: f"format('{{:,.2f}}', round({x} * 100, 2))"
    best = f"(SELECT method, accuracy FROM {_methods()} WHERE accuracy > 0 ORDER BY accuracy DESC, first_seen, method LIMIT 1)"
    grid = " || ',' || ".join(f"sum(n) FILTER (predicted = '{p}')::VARCHAR" for p in L.LABELS)
    return f"""
    SELECT 0 AS section, i::INT AS line, ['EVALUATION REPORT - COMPARISON RESULTS', '', 'Method Name,Sample Count,Accuracy (%),Precision (%),Recall (%),F1-Score (%)'][i + 1] AS cells FROM range(3) t(i)
    UNION ALL SELECT 1, (row_number() OVER (ORDER BY accuracy DESC, first_seen, method))::INT, method || ',' || sample_count || ',' || {f("accuracy")} || ',' || {f("precision")} || ',' || {f("recall")} || ',' || {f("f1_score")} FROM {_methods()}
    UNION ALL SELECT 2, i::INT, ['', 'Best Method:,' || coalesce((SELECT method FROM {best}), ''), 'Best Accuracy:,' || {f(f"coalesce((SELECT accuracy FROM {best}), 0)")} || '%'][i + 1] FROM range(3) t(i)
    UNION ALL SELECT 3, i::INT, ['', 'CONFUSION MATRIX - all methods', '', 'Actual \\ Predicted,Positif,Negatif,Netral'][i + 1] FROM range(4) t(i)
    UNION ALL SELECT 3, (list_position({_list(L.LABELS)}, actual) + 3)::INT, upper(actual[1]) || actual[2:] || ',' || {grid} FROM {_confusion("")} GROUP BY actual"""


def oracle_sql() -> dict[str, str]:
    reviews = _stages(*_REVIEWS)
    auto = _labelled(*_REVIEWS)
    label = _synonym("sentiment")
    pages = "(SELECT row_id, raw, sentiment, confidence, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM labelled WHERE raw IS NOT NULL)"
    labels = f"(SELECT row_id, {label} AS label, md5('senarai' || row_id::VARCHAR) AS mix FROM labelled WHERE raw IS NOT NULL)"
    each = f"greatest(1, {SAMPLE_ROWS} // (SELECT count(DISTINCT label) FROM {labels}))"
    first = f"(SELECT row_id, label, mix FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mix, row_id) AS rn FROM {labels}) WHERE rn <= {each})"
    sampled = f"""WITH f AS {first} SELECT row_id, label FROM f UNION ALL
            (SELECT row_id, label FROM {labels} WHERE row_id NOT IN (SELECT row_id FROM f) ORDER BY mix, row_id LIMIT (SELECT greatest(0, {SAMPLE_ROWS} - count(*)) FROM f))"""
    split = lambda cond: f"(SELECT row_id, text, label FROM {_CLEAN} JOIN (SELECT row_id, {label} AS label FROM labelled WHERE {cond} AND sentiment IS NOT NULL) USING (row_id))"
    stage = lambda name: f"SELECT row_id, {name} FROM {reviews}"
    distribution = _distribution("sentiment", auto)
    return {
        "sentiment_distribution": distribution,
        "sentiment_label": f"SELECT row_id, sentiment, round(confidence, 6) + 0.0 AS confidence FROM {auto}",
        "sentiment_distribution_by_lang": f"SELECT lang, label, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY lang) * 100, 1) AS pct FROM (SELECT lang, sentiment AS label, count(*) AS n FROM {_labelled(*_REVIEWS, 'lang')} GROUP BY ALL)",
        "review_distribution": _distribution("s", f"(SELECT {label} AS s FROM labelled)"),
        "dominance_verdict": f"SELECT CASE WHEN positif > negatif AND positif > netral THEN 'positif' WHEN negatif > positif AND negatif > netral THEN 'negatif' WHEN netral > positif AND netral > negatif THEN 'netral' ELSE 'seimbang' END AS verdict FROM ({distribution})",
        "confidence_bars": "SELECT row_id, round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, (confidence + 1) * 50)), 6) AS bar, CASE WHEN confidence >= 0 THEN 'positif' ELSE 'negatif' END AS colour FROM labelled WHERE confidence IS NOT NULL",
        "distribution_bars": f"SELECT {', '.join(f'round(greatest(20.0::DOUBLE, {x}_percentage * 1.2::DOUBLE), 6) AS {x}' for x in L.LABELS)} FROM ({distribution})",
        "case_fold": stage("case_folding"),
        "cleanse": stage("cleansing"),
        "normalize_slang": stage("normalisasi"),
        "tokenize": stage("tokenizing"),
        "remove_stopwords": stage("filtering"),
        "stem": stage("stemming"),
        "preprocess_full": f"SELECT * FROM {reviews}",
        "preprocess_labelled": _keep_first(_stages("(SELECT row_id, raw AS txt, coalesce(sentiment, 'netral') AS sentiment FROM labelled)", "row_id", "txt", "sentiment"), "row_id, stemming, sentiment"),
        "wrangle_keep_first": _keep_first(reviews, "row_id, stemming"),
        "wrangle_removed_count": f"SELECT count(*) AS n_before, count(DISTINCT k) AS n_after, count(*) - count(DISTINCT k) AS n_removed FROM (SELECT nullif(lower({_trim('stemming')}), '') AS k FROM {reviews})",
        "strict_cleansing": f"SELECT row_id, {_trim(_rx(_rx(_cleanse('lower(ulasan)'), rf'[^\p{{L}}{_S}]'), rf'[{_S}]+'))} AS cleansing FROM raw_reviews WHERE ulasan IS NOT NULL",
        "paginate": f"SELECT row_id, pos, pos // 100 + 1 AS page FROM {pages} WHERE pos BETWEEN 100 AND 199",
        "page_summary": "SELECT count(*) AS total, ceil(count(*) / 100)::BIGINT AS pages, least(count(*), 100) AS last_shown FROM labelled WHERE raw IS NOT NULL",
        "bulk_edit": f"""SELECT p.row_id, CASE WHEN p.row_id % 50 = 0 THEN coalesce(e.sentiment, 'netral') ELSE p.sentiment END AS sentiment, CASE WHEN p.row_id % 50 = 0 THEN 1.0 ELSE p.confidence END::DOUBLE AS confidence
            FROM {pages} p LEFT JOIN {_labelled('labelled', 'row_id', 'raw')} e USING (row_id)""",
        "learned_keywords": f"""SELECT sentiment, word, count(*) AS n FROM (SELECT sentiment, unnest(string_split_regex(lower(raw), {_str(rf'[{_S}]+')})) AS word FROM labelled WHERE raw IS NOT NULL AND sentiment IS NOT NULL)
            WHERE length(word) > 2 AND word NOT IN {_in(L.LEARNING_STOPWORDS)} GROUP BY ALL HAVING count(*) >= 2""",
        "classifier_text": f"SELECT row_id, text FROM {_CLEAN}",
        "document_frequency": f"SELECT term, df FROM {_df(_CLEAN)}",
        "smoothed_idf": f"SELECT term, df, {_r('idf')} FROM {_idf(_CLEAN)}",
        "tfidf_vectors": f"SELECT row_id, term, {_r('w')} FROM {_tfidf(_CLEAN, _idf(_CLEAN))}",
        "idf_stats": f"SELECT {_r('avg_idf', 'min_idf', 'max_idf')}, vocabulary_size FROM (SELECT avg(idf) AS avg_idf, min(idf) AS min_idf, max(idf) AS max_idf, count(*) AS vocabulary_size FROM {_idf(_CLEAN)})",
        "top_terms": f"SELECT term, {_r('tf')}, place FROM (SELECT term, c::DOUBLE / sum(c) OVER () AS tf, (row_number() OVER (ORDER BY c DESC, term))::INT AS place FROM (SELECT term, count(*) AS c FROM {_words(_CLEAN)} WHERE strlen(term) > 1 GROUP BY term)) WHERE place <= 20",
        "top_vocabulary": f"""SELECT term, df, (row_number() OVER (ORDER BY rid, ps))::INT AS place FROM
            (SELECT term, count(DISTINCT row_id) AS df, min(row_id) AS rid, arg_min(ps, row_id * 1000000 + ps) AS ps FROM (SELECT row_id, unnest(w) AS term, generate_subscripts(w, 1) AS ps FROM
              (SELECT row_id, list_filter(string_split(lower(text), ' '), lambda x: trim(x) <> '') AS w FROM {_CLEAN})) WHERE strlen(term) > 1 GROUP BY term ORDER BY df DESC, rid, ps LIMIT 300)""",
        "first_vocabulary": f"""SELECT term, {_r('idf')}, (row_number() OVER (ORDER BY rid, ps))::INT AS place FROM
            (SELECT term, min(row_id) AS rid, arg_min(ps, row_id * 1000000 + ps) AS ps FROM (SELECT row_id, unnest(w) AS term, generate_subscripts(w, 1) AS ps FROM
              (SELECT row_id, list_filter(string_split(lower(text), ' '), lambda x: trim(x) <> '') AS w FROM {_CLEAN})) WHERE strlen(term) > 1 GROUP BY term) JOIN {_idf(_CLEAN)} USING (term)
            QUALIFY place <= 20""",
        "training_summary": f"SELECT vocabulary_size, total_documents, {_r('avg_idf', 'min_idf', 'max_idf')}, n_labels FROM (SELECT count(*) AS vocabulary_size, avg(idf) AS avg_idf, min(idf) AS min_idf, max(idf) AS max_idf FROM {_idf(_CLEAN)}), (SELECT count(*) AS total_documents, count(DISTINCT sentiment) AS n_labels FROM labelled WHERE raw IS NOT NULL)",
        "label_histogram": f"SELECT label, count(*) AS n FROM ({sampled}) GROUP BY label",
        "stored_accuracy": f"""SELECT method_name, total_samples, correct_predictions, total_samples - correct_predictions AS wrong_predictions, round(correct_predictions::DOUBLE / total_samples, 6) + 0.0 AS accuracy
            FROM (SELECT lower({_trim('method_name')}) AS method_name, count(*) AS total_samples, count(*) FILTER (lower({_trim("coalesce(actual_label, '')")}) NOT IN ('', '0')
              AND lower({_trim('actual_label')}) = lower({_trim('predicted_label')})) AS correct_predictions FROM predictions GROUP BY 1)""",
        "sentiment_filter": "SELECT row_id, sentiment FROM labelled WHERE lower(sentiment) = 'positif'",
        "stratified_sample": sampled,
        "class_metrics": f"SELECT method, label, tp, fp, fn, {_r('precision', 'recall', 'f1_score')} FROM {_class_metrics('method,')}",
        "macro_metrics": f"SELECT sample_count, correct, {_r('accuracy', 'precision', 'recall', 'f1_score')} FROM (SELECT *, correct::DOUBLE / sample_count AS accuracy FROM (SELECT (SELECT count(*) FROM predictions) AS sample_count, sum(tp)::BIGINT AS correct, sum(precision) / 3 AS precision, sum(recall) / 3 AS recall, sum(f1_score) / 3 AS f1_score FROM {_class_metrics('')}))",
        "confusion_matrix": f"SELECT * FROM {_confusion('method, ')}",
        "confusion_metrics": f"""SELECT label, {_r('precision', 'recall')}, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) + 0.0 AS f1_score, round(correct::DOUBLE / total, 6) + 0.0 AS accuracy, correct, total - correct AS incorrect
            FROM (SELECT label, coalesce(tp::DOUBLE / nullif(col_n, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(row_n, 0), 0) AS recall, correct, total
              FROM (SELECT label, (sum(n) FILTER (actual = label AND predicted = label))::BIGINT AS tp, sum(n) FILTER (actual = label) AS row_n, sum(n) FILTER (predicted = label) AS col_n, (sum(n) FILTER (actual = predicted))::BIGINT AS correct, max(total_samples) AS total
                FROM {_confusion('')} CROSS JOIN {_CLASSES} GROUP BY label))""",
        "compare_methods": f"SELECT method, sample_count, {_r('accuracy', 'precision', 'recall', 'f1_score')}, (row_number() OVER (ORDER BY accuracy DESC, first_seen, method))::INT AS place FROM {_methods()}",
        "best_method": f"SELECT method AS best_method, round(accuracy, 6) + 0.0 AS best_accuracy FROM {_methods()} WHERE accuracy > 0 ORDER BY accuracy DESC, first_seen, method LIMIT 1",
        "evaluation_report": _report(),
        "cosine_knn": f"""WITH tr AS MATERIALIZED {split("split = 'train'")}, te AS MATERIALIZED (SELECT row_id, text FROM {_CLEAN} JOIN (SELECT row_id FROM labelled WHERE split IN ('test', 'valid')) USING (row_id)), idf AS MATERIALIZED {_idf("tr")},
            l AS (SELECT row_id, label, md5('senarai' || row_id::VARCHAR) AS mix FROM tr),
            f AS MATERIALIZED (SELECT row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mix, row_id) AS rn FROM l) WHERE rn <= greatest(1, {SAMPLE_ROWS} // (SELECT count(DISTINCT label) FROM l))),
            s AS MATERIALIZED (SELECT row_id, label FROM f UNION ALL (SELECT row_id, label FROM l WHERE row_id NOT IN (SELECT row_id FROM f) ORDER BY mix, row_id LIMIT (SELECT greatest(0, {SAMPLE_ROWS} - count(*)) FROM f))),
            a AS MATERIALIZED {_tfidf("(SELECT row_id, text FROM tr WHERE row_id IN (SELECT row_id FROM s))", "idf")}, b AS MATERIALIZED {_tfidf("te", "idf")},
            sim AS (SELECT b.row_id, a.row_id AS t, sum(a.w * b.w) AS sim FROM a JOIN b USING (term) GROUP BY ALL),
            near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(sim, 9) DESC, t) AS rn FROM sim) WHERE rn <= 5),
            votes AS (SELECT near.row_id, label, sum(sim) AS vote FROM near JOIN s ON s.row_id = t GROUP BY ALL),
            best AS (SELECT row_id, label, vote / sum(vote) OVER (PARTITION BY row_id) AS c, row_number() OVER (PARTITION BY row_id ORDER BY round(vote, 9) DESC, label) AS rn FROM votes)
            SELECT row_id, coalesce(label, 'netral') AS predicted_label, round(coalesce(c, 0), 6) + 0.0 AS confidence FROM (SELECT DISTINCT row_id FROM te) LEFT JOIN (SELECT * FROM best WHERE rn = 1) USING (row_id)""",
        "stream_sentiment": f"SELECT row_id, sentiment, round(confidence, 6) + 0.0 AS confidence FROM {auto}",
    } | _sources() | _p6()


def _strict(t: str) -> str:
    """Label of a text in t whose phrases are matched as whole words."""
    pad = lambda words: [f" {w} " for w in words]
    total = _sum("w", {v: pad(p) for v, p in L.VALENCES.items()})
    factor = f"CASE WHEN {_any('w', pad(L.INTENSIFIERS))} THEN 1.293 ELSE 1.0 END::DOUBLE * CASE WHEN {_any('w', pad(L.NEGATIONS))} THEN -0.74 ELSE 1.0 END::DOUBLE"
    return f"""SELECT row_id, CASE WHEN s / sqrt(s * s + 15) >= 0.05 THEN 'positif' WHEN s / sqrt(s * s + 15) <= -0.05 THEN 'negatif' ELSE 'netral' END AS sentiment
      FROM (SELECT row_id, ({total}) * {factor} AS s FROM (SELECT row_id, ' ' || {_rx(f"lower({t})", "[^\\p{L}\\p{N}-]+")} || ' ' AS w FROM raw_reviews WHERE {t} IS NOT NULL))"""


def _analysis() -> str:
    text = _trim("coalesce(ulasan, '')")
    count = lambda sign: " + ".join(f"len(list_filter({_list(p)}, lambda k: contains(t, k)))" for v, p in L.VALENCES.items() if v * sign > 0)
    factor = f"CASE WHEN {_any('t', L.INTENSIFIERS)} THEN 1.293 ELSE 1.0 END::DOUBLE * CASE WHEN {_any('t', L.NEGATIONS)} THEN -0.74 ELSE 1.0 END::DOUBLE"
    return f"""SELECT row_id, o AS original_text, o AS translated_text, round(n::DOUBLE / w, 3) AS neg, round((w - p - n)::DOUBLE / w, 3) AS neu, round(p::DOUBLE / w, 3) AS pos, round(c, 4) + 0.0 AS compound,
             CASE WHEN c > 0.05 THEN 'positive' WHEN c < -0.05 THEN 'negative' ELSE 'neutral' END AS label
      FROM (SELECT *, greatest(len(string_split_regex(t, {_str(f"[{_S}]+")})), p + n, 1) AS w, s / sqrt(s * s + 15) AS c
        FROM (SELECT *, {count(1)} AS p, {count(-1)} AS n, (({_sum("t", L.VALENCES)}) + ({_sum("t", L.SCORE_ONLY)})) * {factor} AS s
          FROM (SELECT *, lower(o) AS t FROM (SELECT row_id, CASE WHEN {text} = '' THEN 'Saya merasa netral tentang topik ini.' ELSE {text} END AS o FROM raw_reviews))))"""


def _column_rules(tables: tuple[str, ...]) -> str:
    one = lambda cond, by="ordinal_position": f"arg_min(column_name, {by}) FILTER ({cond})"
    has = lambda names: " OR ".join(f"contains(low, {_str(k)})" for k in names)
    order = lambda names: f"list_position({_list(names)}, lower(column_name))"
    at = lambda k: f"max(column_name) FILTER (ordinal_position = {k})"
    last, wanted, review = "arg_max(column_name, ordinal_position)", ("text", "raw", "sentiment", "label"), ("raw", "text", "tweet", "content")
    by_name = lambda names: one(f"lower(column_name) IN {_in(names)}", order(names))
    return f"""SELECT table_name, string_agg(column_name, ',' ORDER BY ordinal_position) FILTER (NOT ({has(S.DROP_KEYWORDS)})) AS kept,
        coalesce({one(f"low IN {_in(S.PREPROCESS_TEXT)}")}, {last}) AS preprocess_text, coalesce({one(f"low IN {_in(S.LABELLING_TEXT)}")}, {last}) AS labelling_text,
        coalesce({one(has(S.CLASSIFIER_TEXT))}, {at(1)}) AS classifier_text, coalesce({one(has(S.CLASSIFIER_LABEL))}, {at(2)}) AS classifier_label,
        {one(f"low IN {_in(wanted)}")} AS by_column, {by_name(wanted)} AS by_name,
        bool_or(low = 'raw') AND bool_or(low IN ('sentiment', 'label')) AS is_labelled, count(*) FILTER (low IN {_in(S.EVALUATION_REQUIRED)}) = 4 AS is_complete,
        {by_name(("sentiment", "label"))} AS review_label, coalesce({by_name(review)}, {at(1)}) AS review_text
      FROM (SELECT *, lower(trim(column_name)) AS low FROM information_schema.columns WHERE table_name IN {_in(tables)}) GROUP BY table_name"""


def _sources() -> dict[str, str]:
    cells = lambda *names: ", ".join(f"coalesce({n}, '') AS {n}" for n in names)
    preprocessed = _keep_first(_stages("(SELECT row_id, raw AS txt, coalesce(sentiment, 'netral') AS sentiment FROM labelled)", "row_id", "txt", "sentiment"), "stemming AS preprocessed, sentiment")
    return {
        "strict_label": _strict("ulasan"),
        "analyze_service": _analysis(),
        "csv_scan": f"SELECT row_id::VARCHAR AS row_id, {cells('ulasan')}, coalesce('  ' || app_id || ' ', '') AS app_id, {cells('source')} FROM raw_reviews",
        "csv_scan_trimmed": f"SELECT row_id::VARCHAR AS row_id, {_trim("coalesce(ulasan, '')")} AS ulasan, {_trim("coalesce(app_id, '')")} AS app_id, {_trim("coalesce(source, '')")} AS source FROM raw_reviews",
        "csv_preview": "SELECT row_id::VARCHAR AS row_id, coalesce('  ' || app_id || ' ', '') AS app_id FROM raw_reviews ORDER BY raw_reviews.row_id LIMIT 100",
        "result_store": "SELECT row_id, raw, sentiment, confidence FROM labelled",
        "result_removal": "SELECT true AS removed, false AS removed_again",
        "sink_preprocessed": preprocessed,
        "sink_labelled": f"SELECT raw, sentiment, round(confidence, 6) + 0.0 AS confidence FROM {_labelled(*_REVIEWS)}",
        "sink_predictions": f"SELECT {cells('text', 'actual_label', 'predicted_label')}, confidence FROM predictions",
        "sink_report": f"SELECT row_number() OVER (ORDER BY section, line) - 1 AS line, cells AS value FROM ({_report()})",
        "column_rules": _column_rules(RULED_TABLES),
        "file_names": "SELECT id, split_part(path, '/', -1) AS name FROM preprocessing_files",
        "first_seen_labels": f"SELECT {_synonym('sentiment')} AS label, min(row_id) AS first_seen FROM labelled WHERE split = 'train' AND raw IS NOT NULL AND sentiment IS NOT NULL GROUP BY 1",
        "edit_summary": """SELECT 2 * count(*) + count(*) FILTER (odd) AS n_edits, 2 * count(*) FILTER (odd) AS n_invalid, count(*) FILTER (NOT odd) AS updated_count
            FROM (SELECT row_id % 150 = 0 AS odd FROM labelled WHERE raw IS NOT NULL AND row_id % 50 = 0)""",
    }


def _p6() -> dict[str, str]:
    """The grammar of a record as one regular expression, its fields taken off one by one."""
    field = r'(?:"(?:[^"]|"")*"|[^",]*)'
    good = f"regexp_full_match(line, {_str(f'(?s){field}(?:,{field})*')})"
    three = f"regexp_full_match(line, {_str(f'(?s){field},{field},{field}')})"
    part = lambda i: f"regexp_extract(line, {_str(f'(?s)^({field}),({field}),({field})$')}, {i})"
    clean = lambda x: f"CASE WHEN {x} LIKE '\"%' THEN replace({x}[2:-2], '\"\"', '\"') ELSE {x} END"
    number = r"[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*"
    cast = "try_cast(trim(c, ' ' || chr(9)) AS DOUBLE)"
    rows = f"""(SELECT line_id, file_id, u, s, {cast} AS v, CASE WHEN NOT good THEN 'quoting' WHEN NOT three THEN 'columns'
              WHEN regexp_full_match(u, '[\\s\\p{{Z}}]*') OR s NOT IN {_in(L.LABELS)} OR NOT regexp_full_match(c, {_str(number)}) OR NOT coalesce({cast} BETWEEN -1 AND 1, false) THEN 'value' END AS reason
        FROM (SELECT line_id, file_id, {good} AS good, {three} AS three, {clean(part(1))} AS u, {clean(part(2))} AS s, {clean(part(3))} AS c FROM upload_lines WHERE line IS NOT NULL))"""
    return {
        "p6_found": f"SELECT line_id, reason FROM {rows} WHERE reason IS NOT NULL",
        "p6_loaded": f"SELECT line_id, u AS ulasan, s AS sentiment, v AS confidence FROM {rows} WHERE reason IS NULL",
        "p6_report": f"SELECT file_id, coalesce(reason, 'loaded') AS reason, count(*) AS n FROM {rows} GROUP BY ALL",
    }
