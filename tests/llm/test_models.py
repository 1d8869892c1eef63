"""Personal information, languages and subjects on written cases and held-out accuracy."""

import os

import pytest

from senarai.llm import langid, pii, subjects

NAMES = frozenset(("sari", "tono", "wati"))
FOUND = [
    ("email saya sari.t+x@kotak.example ya", {"email"}), ("tulis ke a-b [at] mail [dot] kotak [dot] example", {"email"}), ("ke a(at)b.example", {"email"}),
    ("kirim a_b @ c.example,", {"email"}), ("ke a at b dot com ya", {"email"}), ("WA 0812-3456-7890", {"phone"}), ("hp 08 12 34 56 78 90", {"phone"}), ("(+62)812-3456-7890", {"phone"}),
    ("telepon (021) 5557 361", {"phone"}), ("0812345678901234567", set()), ("WA nol delapan satu dua, tiga empat lima enam tujuh", {"phone"}), ("nol delapan kali", set()), ("NIK 1234561505801234", {"id_number"}), ("KTP 123456 550580 1234", {"id_number"}),
    ("kode voucher 1234561505801234", set()), ("1234569905801234", set()), ("NPWP 01.234.567.8-901.234", {"id_number"}), ("INV/0841/2025/20488", set()),
    ("Versi 4.23.4, 086816887660 aktif", {"phone"}), ("total Rp 2.565.000. nik:6895105505769414", {"id_number"}), ("rumah di Jl. Melati No. 10", {"address"}), ("jl melati 42, kota", {"address"}),
    ("Gg. Melati RT 05/RW 04", {"address"}), ("Komplek Melati Blok A88 no 37", {"address"}), ("Perum Melati Asri blok E/79", {"address"}),
    ("tidak ada jalan keluar nomor 3", set()), ("jalan-jalan ke Melati 8 hari", set()), ("macet di jalan tol 3 jam", set()), ("I live at 44 Melati Street", {"address"}),
    ("Melati Road No. 86", {"address"}), ("after 22 complaints the toll road traffic", set()), ("nama saya Budi Santoso", {"person_name"}), ("mbak rini sangat sopan", {"person_name"}),
    ("bu CS dan pak satpam baik", set()), ("salam, Sari", {"person_name"}), ("di kota Sari ramai", set()), ("@sari_resmi #tono", set()), ("sari datang", {"person_name"}),
    ("tanggal 10-05-2025 jam 08:42, versi 4.10.8, tiket #20257872-2497", set()), ("", set()), ("- Budi Santoso.", {"person_name"}), ("saya Budi Santoso dari Medan", {"person_name"}),
]


@pytest.mark.parametrize("text,kinds", FOUND)
def test_kinds(text, kinds):
    assert {k for k, *_ in pii.find_personal(text, NAMES)} == kinds


def test_validators():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.birth_date("1234567112801234") and not pii.birth_date("1234563213801234") and not pii.birth_date("1234563102801234")
    assert {k for k, *_ in pii.find_personal("kartu 5500 0000 0000 0004 dan GB82 WEST 1234 5698 7654 32", frozenset())} == {"card", "account"}


def test_surnames_outside_the_list_belong_to_a_listed_name():
    for text, name in (("kemarin Sari Wibowo datang", "Sari Wibowo"), ("kemarin Sari A. Wibowo datang", "Sari A. Wibowo"), ("Tono datang lagi", "Tono"), ("sari wibowo", "sari"), ("Sari, Wibowo", "Sari")):
        assert [text[a:b] for _, a, b, _ in pii.find_personal(text, NAMES)] == [name]


def test_redaction(spark):
    rows = [(1, "Hubungi Sari Tono di 0812-3456-7890, a@b.example"), (2, None), (3, ""), (4, "x " * 50_000 + "WA 081234567890")]
    df = spark.createDataFrame(rows, "row_id bigint, t string").selectExpr("*", "0 AS kind", "'x' AS text")
    got = {r.row_id: (r.text, r.n_spans) for r in pii.redacted(df, "row_id", "t", NAMES).collect()}
    assert got[1] == ("Hubungi [PERSON_NAME] di [PHONE], [EMAIL]", 4) and got[2] == (None, 0) and got[3] == ("", 0)
    assert got[4][0].endswith("WA [PHONE]")
    spans = pii.personal_spans(df, "row_id", "t", NAMES).where("row_id = 1").orderBy("start").collect()
    assert [rows[0][1][r.start : r.end] for r in spans] == ["Sari", "Tono", "0812-3456-7890", "a@b.example"]
    assert pii.personal_spans(df.limit(0), "row_id", "t", NAMES).count() == 0
    names = spark.createDataFrame([("Sari ",), (None,), ("",), ("SARI",)], "n string")
    assert pii.known_names(names, "n") == frozenset(("sari",))


SENTENCES = {
    "id": ["petugas sangat membantu keluarga kami", "pelayanan selalu terlambat setiap hari", "pengiriman barang lebih cepat dari perkiraan", "saya akan menceritakan semuanya kepada tetangga"],
    "en": ["the service was much faster than expected", "my experience made me smile every morning", "the whole process keeps failing for no reason", "we would tell all of our neighbours about this"],
    "zh": ["服务比预期快得多", "昨天晚上一切都很顺利", "我觉得客服还需要改进", "邻居告诉我价格太贵了"],
}


def _profiles():
    return langid.fit([(lang, s) for lang, ss in SENTENCES.items() for s in ss], [], dimension=1024)


def test_languages(spark):
    mixed = "Petugas sangat membantu keluarga kami setiap hari. The service was much faster than expected by all."
    rows = [
        (1, "Pelayanan sangat cepat dan membantu keluarga saya.", None), (2, "The service made all of us smile.", "id-ID"), (3, mixed, "id"), (4, "Petugas sangat membantu keluarga kami!", "IND"),
        (5, None, "id"), (6, "", None), (7, "123 !!", None), (8, "昨天晚上客服比预期快得多，我觉得一切都很顺利，价格太贵了还需要改进。", "en"), (9, "ok", None), (10, "Pelayanan selalu cepat. " * 5_000, "und"),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, t string, lab string").selectExpr("*", "1 AS lang", "2 AS langs")
    got = sorted((r.row_id, r.lang) for r in langid.label_corrections(df, "row_id", "t", "lab", _profiles()).collect())
    assert got == [(1, "id"), (2, "en"), (3, "en"), (3, "id"), (8, "zh"), (10, "id")]
    segments = [(r.lang, mixed[r.start : r.end].strip()) for r in langid.language_segments(df, "row_id", "t", _profiles()).where("row_id = 3").orderBy("start").collect()]
    assert segments == [("id", "Petugas sangat membantu keluarga kami setiap hari."), ("en", "The service was much faster than expected by all.")]
    whole = {r.row_id: r for r in langid.text_languages(df, "row_id", "t", _profiles()).collect()}
    assert whole[7].lang is None and whole[7].langs == [] and whole[7].confidence == 0.0 and 5 not in whole
    assert whole[1].n_letters == sum(map(str.isalpha, rows[0][1])) and whole[1].confidence > 0.9
    assert langid.label_corrections(df.limit(0), "row_id", "t", "lab", _profiles()).count() == 0


def test_stretches_without_full_stops():
    p = _profiles()
    run_on = "Petugas sangat membantu keluarga kami setiap hari The service was much faster than expected by all"
    *_, found, _ = langid.sentence_languages(p, [run_on, "昨天晚上客服比预期快得多 petugas sangat membantu keluarga kami", "Petugas sangat membantu keluarga Sarah Smith"])
    assert [{langid.LANGUAGES[k] for k in s} for s in found] == [{"id", "en"}, {"id", "zh"}, {"id"}]


def test_segments_have_the_languages_of_the_text(spark):
    run_on = "Petugas sangat membantu keluarga kami setiap hari The service was much faster than expected by all"
    texts = [run_on, run_on.swapcase(), "Pelayanan cepat. " + run_on + ". 昨天晚上一切都很顺利", "The service was fast Saya Aku Di Ke Ya kami", "😀", "a b c d"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, t string")
    sets = {r.row_id: r.langs for r in langid.text_languages(df, "row_id", "t", _profiles()).collect()}
    cut: dict[int, set[str]] = {}
    for r in langid.language_segments(df, "row_id", "t", _profiles()).collect():
        cut.setdefault(r.row_id, set()).add(r.lang)
    assert {i: set(s) for i, s in sets.items() if s} == cut and cut[0] == {"id", "en"}


def test_drawn_out_letters_tell_no_language():
    split = langid.split_batch(["haaaaalo", "haalo", "aaaaaaaaaaaaaaaaaaaa"])
    runs = {t: split.runs[a:b].tolist() for t, a, b in zip(split.text[split.sentence], split.starts, [*split.starts[1:], None])}
    assert runs[0] == runs[1] and len(runs[2]) == 1 and split.letters.max() == 20


def test_batches_equal_single_texts():
    texts = ["Petugas membantu. The service was fast", "", "a", "昨天晚上。一切", "x" * 3_000, "kata\n\nkata lain!!! ok?"]
    p = _profiles()
    *_, main, sets, _ = langid.sentence_languages(p, texts)
    for i, t in enumerate(texts):
        *_, one, own, _ = langid.sentence_languages(p, [t])
        assert one[0] == main[i] and own[0] == sets[i]


FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_sentences(spark):
    rows = [(r.lang, r.sample) for r in spark.read.parquet(f"{FOLDER}/lang_samples.parquet").orderBy("sample_id").collect()]
    profiles = langid.fit([r for i, r in enumerate(rows) if i % 4], [])
    held = [r for i, r in enumerate(rows) if i % 4 == 0]
    *_, main, _, _ = langid.sentence_languages(profiles, [s for _, s in held])
    assert sum(langid.LANGUAGES[k] == lang for k, (lang, _) in zip(main, held)) >= 0.93 * len(held)


TOPICS = {"food": "nasi goreng", "sport": "bola voli"}


def test_subjects(spark):
    docs, labels = [], []
    for i in range(120):
        s = ("food", "sport")[i % 2]
        docs.append((i, f"Hari ini {TOPICS[s]} enak sekali nomor {i}. Semua {TOPICS[s]} lancar. Petugas ramah."))
        if i < 40:
            labels.append((i, s))
    docs += [(500, "Nasi goreng enak. Lalu bola voli seru."), (501, None), (502, ""), (503, "Petugas ramah. Hari ini enak sekali."), (504, "Bola voli. " * 5_000)]
    labels += [(0, None), (None, "food"), (1, "lain"), (2, "food"), (9_999, "food")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "0 AS mask", "0 AS f")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string")
    rows = subjects.propagate(df, "doc_id", "text", lab, "doc_id", "subject", ["food", "sport"]).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert all(got[i] == {("food", "sport")[i % 2]} for i in range(120))
    assert got[500] == {"food", "sport"} and got[504] == {"sport"} and not {501, 502, 503} & set(got)
    assert len(rows) == len({tuple(r) for r in rows})
    assert subjects.propagate(df, "doc_id", "text", lab.limit(0), "doc_id", "subject", ["food", "sport"]).count() == 0
    assert subjects.propagate(df.limit(0), "doc_id", "text", lab, "doc_id", "subject", ["food", "sport"]).count() == 0


def test_hubs_in_blocks_give_the_same(spark, monkeypatch):
    docs = [(i, f"Hari ini {TOPICS[s]} enak nomor {i}. Semua {TOPICS[s]} lancar.") for i, s in enumerate(("food", "sport") * 30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, ("food", "sport")[i % 2]) for i in range(20)], "doc_id bigint, subject string")
    run = lambda: sorted(tuple(r) for r in subjects.propagate(df, "doc_id", "text", lab, "doc_id", "subject", ["food", "sport"]).collect())
    whole = run()
    monkeypatch.setattr(subjects, "BLOCK_HUBS", 4)
    assert len(whole) == 60 and run() == whole


def test_sentences_have_the_subject_of_most_hubs_and_held_out_ones_none(spark):
    docs = [(i, f"Nilai {('ujian sekolah', 'pasar saham')[i % 2]} naik nomor {i}.") for i in range(80)] + [(900, "Nilai ujian sekolah."), (901, "Ujian sekolah titipan.")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, ("education", "finance")[i % 2]) for i in range(30)], "doc_id bigint, subject string")
    held = spark.createDataFrame([("Awal. Ujian sekolah titipan! Akhir",), (None,)], "passage string")
    got = {r.doc_id: r.subject for r in subjects.propagate(df, "doc_id", "text", lab, "doc_id", "subject", ["education", "finance"], held, "passage").collect()}
    assert got[900] == "education" and 901 not in got and all(got[i] == ("education", "finance")[i % 2] for i in range(80))


def test_phrases():
    assert subjects.phrases("Nasi goreng, 12 é") == {"nasi", "goreng", "nasi goreng", "é"}
    assert "登录" in subjects.phrases("登录页面在Jassa那边") and "jassa" in subjects.phrases("登录页面在Jassa那边")
