"""Personal information inside free text: spans with a kind and a score, and the text with typed placeholders.

Regular expressions propose spans. Validators confirm them: Luhn for card numbers, mod-97 for account numbers, the birth
date inside a citizen number, the digit count of phone and tax numbers. Words next to a span raise or lower its score
(`voucher`, `invoice` and the like lower it, `telepon` or `nama` raise it). Spans that reach the threshold are kept, a
character belongs to at most one span, kinds in this order: email, address, id_number, account, phone, card, person_name.
User handles, hashtags and links are never searched for names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "address", "id_number", "account", "phone", "card", "person_name")
THRESHOLD = 0.5
MAX_NAMES = 200_000
CONTEXT_CHARS = 24

_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|titik)\s?[\])}]\s?|\s(?:dot|titik)\s)"
_EMAIL = re.compile(
    r"(?<![\w.+-])[a-z0-9][\w.+-]*(?:@|\s@\s|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s(?=[a-z0-9-]+\s?[\[({]?\s?(?:dot|titik)\b))"
    rf"[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}(?![\w-])",
    re.I,
)
_SKIP = re.compile(r"\S+://\S+|(?<!\w)[@#]\w+(?:[.-]\w+)*")

_NAME_WORDS = r"(?:[^\W\d_][\w'’-]*\.?\s+)"
_ADDRESS = re.compile(
    rf"(?<![\w-])(?P<kind>jl|jln|jalan|gg|gang|komp|komplek|kompleks|perum|perumahan|griya|dusun|dsn|desa|kp|kampung|rumah\s+susun)\b\.?\s*"
    rf"(?P<first>[^\W\d_][\w'’-]*)\.?,?\s+{_NAME_WORDS}{{0,3}}?"
    r"(?P<mark>(?:no|nomor|nomer|blok|rt|gg|gang)\b\.?\s*)?(?P<number>[a-z]{0,2}\s?[/-]?\d{1,4}[a-z]?\b)"
    r"(?P<rest>(?:[\s,/]*(?:no|nomor|rt|rw|blok|gang|gg)\b\.?\s*[a-z]{0,2}[/-]?\d{1,4}[a-z]?\b)*)(?P<after>\s*%?\w*)",
    re.I,
)
_ADDRESS_EN = re.compile(
    r"(?<![\w.])\d{1,4}\s+(?P<first>[^\W\d_]+)\s+(?:[A-Z][\w'’-]+\s+){0,2}(?i:street|road|avenue|lane|boulevard)\b(?:,?\s*(?i:unit|apt|no)\.?\s*\d+)?"
    r"|(?<!\w)(?P<name>[^\W\d_]+)\s+(?i:street|road|avenue|lane|boulevard)\s*,?\s*(?i:no|number|unit)\b\.?\s*\d{1,4}\b"
)
#: Words that follow `jalan` and the like in other senses, and units after a number that is no house number.
_NO_STREET = frozenset("keluar tol ke di kaki terus pintas tengah dan yang ini itu saja buntu cerita nya lain masuk pulang tikus satu dua".split())
_NO_STREET_EN = frozenset("the a an toll main off on this that road railroad complaints times".split())
_UNITS = frozenset("hari jam menit detik kali bulan tahun minggu km kilo meter ribu rb juta jt persen orang days hours times weeks months years".split())
_WEAK_STREETS = frozenset(("dusun", "dsn", "desa", "kp", "kampung", "griya"))

_DIGIT = re.compile(r"\d")
_DIGITS = re.compile(r"\d(?:[\s().+-]*\d){8}")
_NIK = re.compile(r"(?<![\d/#])(?<!\d[.-])(?:\d[ .-]?){15}\d(?![.-]?\d)")
_NPWP = re.compile(r"(?<![\d/#])(?<!\d[.-])\d{2}[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d[ .-]?\d{3}[ .-]?\d{3}(?![.-]?\d)")
_MOBILE = re.compile(r"(?<![\d/#])(?<!\d[.-])(?:\(?\+?62\)?[\s.-]?(?:\(0\))?|\(?0)8\)?(?:[\s.-]?\d){7,11}(?![.-]?\d)")
_LANDLINE = re.compile(r"(?<![\d/#])(?<!\d[.-])(?:\(0[2-9]\d{1,2}\)|(?:\(?\+?62\)?[\s.-]?|0)[2-7]\d{1,2})[\s.-]?\d{3,4}[\s.-]?\d{3,4}(?![.-]?\d)")
_SPELLED = re.compile(r"(?<!\w)(?:nol|kosong|zero|oh|plus)(?:[\s,.-]+(?:nol|kosong|satu|dua|tiga|empat|lima|enam|tujuh|delapan|lapan|sembilan|zero|oh|one|two|three|four|five|six|seven|eight|nine)){8,14}(?!\w)", re.I)
_SPELLED_HINTS = frozenset(("nol", "kosong", "zero", "oh"))
_CARD = re.compile(r"(?<![\d/#])(?<!\d[.-])(?:\d[ -]?){12,18}\d(?![.-]?\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_BREAK = re.compile(r"[.,!?;]\s|\n")
_AGAINST = re.compile(r"\b(?:voucher|vocer|kupon|coupon|invoice|inv|faktur|tiket|ticket|kode|code|resi|order|pesanan|transaksi|versi|version|tanggal|rp)\b", re.I)
_FOR_PHONE = re.compile(r"\b(?:hp|wa|whatsapp|telp|telepon|tlp|hubungi|nomor|no|phone|call|number|kontak|contact)\b", re.I)
_FOR_ID = re.compile(r"\b(?:nik|ktp|npwp|pajak|identitas|national id|id|data diri|tax)\b", re.I)

_TITLE = r"pak|bu|bapak|ibu|mbak|mas|bang|kak|mr|mrs|ms"
_INTRO = re.compile(
    r"\b(?:nama\s+(?:saya|aku|gue|sy)|my\s+name\s+is|atas\s+nama|a\.\s?n\.|bernama|called|named|salam,|regards,|hormat\s+saya,)\s*"
    r"(?P<a>[^\W\d_]{2,})(?:\s+(?P<i>[^\W\d_]\.))?(?:\s+(?P<b>[^\W\d_]{2,}))?",
    re.I,
)
_TITLED = re.compile(rf"\b(?P<title>{_TITLE})\b\.?\s+(?P<c>[^\W\d_]{{2,}})(?:\s+(?P<d>[^\W\d_]{{2,}}))?", re.I)
_SIGNED = re.compile(
    r"(?:^|[^\w\s,]\s*|\n\s*)-\s+(?P<x>[^\W\d_]{2,})(?:\s+[^\W\d_]\.)?\s+(?P<y>[^\W\d_]{2,}|[^\W\d_]\.)(?=\s*(?:[.,!?;\n<(\[]|$|[^\w\s]))"
)
_FROM = re.compile(r"\b(?:saya|aku|i\s+am|i'm)\s+(?P<x>[^\W\d_]{2,})(?:\s+[^\W\d_]\.)?(?:\s+(?P<y>[^\W\d_]{2,}))?\s+(?:dari|from)\b", re.I)
_FOLLOWING = re.compile(r"(?:\s[^\W\d_]\.)?\s(?P<y>[^\W\d_]{2,})")
#: Words without which a pattern can't match, so that most texts are searched by few patterns.
_INTRO_HINTS = frozenset("nama name bernama called named salam regards hormat".split())
_TITLE_HINTS = frozenset(_TITLE.split("|"))
_ADDRESS_HINTS = frozenset("jl jln jalan gg gang komp komplek kompleks perum perumahan griya dusun dsn desa kp kampung rumah".split())
_ADDRESS_EN_HINTS = frozenset("street road avenue lane boulevard".split())
#: Roles that follow a title without being a name, and words that are no name after an introduction.
_ROLES = frozenset(
    "cs satpam guru dokter bidan lurah rt rw camat hakim polisi sopir kurir ojek haji ustad kasir teller admin perawat dosen "
    "petugas karyawan penjual pedagang bos direktur manajer kades yang dan di ke itu ini saya kami kita nya sangat tidak juga "
    "sudah ada hamil rumah tangga anak the a my your our his her by for from on in at me us back".split()
)
#: A word before a known name that makes it a place, brand or product.
_NOT_PERSON = frozenset("di ke kota daerah kawasan wewengkon tlatah pelosok cabang promo iklan iklane brosur paket seri varian fitur menu soal pakai produk merek toko the around near seperti".split())
_WORD = re.compile(r"[^\W\d_]{2,}")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def birth_date(nik: str) -> bool:
    day, month = int(nik[6:8]), int(nik[8:10])
    day -= 40 * (day > 40)
    longest = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    return 1 <= month <= 12 and 1 <= day <= longest[month - 1]


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


class _Spans:
    """The spans found so far, and the text with them blanked out."""

    def __init__(self, text: str):
        self.text, self.found, self.low = text, [], text.lower()
        self.words = frozenset(_WORD.findall(self.low))

    def add(self, kind: str, start: int, end: int, score: float) -> None:
        self.found.append((kind, start, end, round(min(score, 1.0), 3)))
        self.hide(start, end)

    def hide(self, start: int, end: int) -> None:
        self.text = self.text[:start] + "\x01" * (end - start) + self.text[end:]

    def before(self, start: int) -> str:
        return self.text[max(0, start - CONTEXT_CHARS) : start].rpartition("\x01")[2]


def _emails(s: _Spans) -> None:
    low = s.low
    if "@" in low or "dot" in s.words or "titik" in s.words or "at" in s.words and ("at)" in low or "at]" in low or "at}" in low or "at>" in low):
        for m in list(_EMAIL.finditer(s.text)):
            s.add("email", m.start(), m.end(), 0.9 if "@" in m[0] else 0.8)


def _addresses(s: _Spans) -> None:
    for m in [] if s.words.isdisjoint(_ADDRESS_HINTS) else list(_ADDRESS.finditer(s.text)):
        kind, first, marked = m["kind"].lower(), m["first"].lower(), bool(m["mark"] or m["rest"].strip())
        score = 0.6
        if first in _NO_STREET:
            score -= 0.5
        if not marked:
            score -= 0.5 if kind in _WEAK_STREETS or m["after"].strip().lower() in _UNITS or m["after"].startswith("%") else 0.05
        if re.search(r"[.!?]\s", s.text[m.end("first") + 1 : m.start("number")].replace("No.", "").replace("no.", "")):
            score -= 0.5
        if score >= THRESHOLD:
            s.add("address", m.start(), m.end("rest"), score + 0.2 * marked)
    if not s.words.isdisjoint(_ADDRESS_EN_HINTS):
        for m in list(_ADDRESS_EN.finditer(s.text)):
            if (m["first"] or m["name"]).lower() not in _NO_STREET_EN:
                s.add("address", m.start(), m.end(), 0.7)


def _numbers(s: _Spans) -> None:
    def each(pattern: re.Pattern, kind: str, base: float, valid, supports: re.Pattern | None) -> None:
        for m in list(pattern.finditer(s.text)):
            digits = _digits(m[0])
            if not valid(digits):
                continue
            near = _BREAK.split(s.before(m.start()))[-1]
            last = lambda p: max((x.end() for x in p.finditer(near)), default=-1)
            against, supported = last(_AGAINST), last(supports) if supports else -1
            score = base + (0.3 if supported > against else -0.5 if against >= 0 else 0.0)
            if score >= THRESHOLD:
                s.add(kind, m.start(), m.end(), score)

    each(_NIK, "id_number", 0.65, birth_date, _FOR_ID)
    each(_NPWP, "id_number", 0.6, lambda d: len(d) == 15, _FOR_ID)
    for m in list(_IBAN.finditer(s.text)):
        if mod97(m[0].replace(" ", "")):
            s.add("account", m.start(), m.end(), 0.9)
    each(_MOBILE, "phone", 0.7, lambda d: 9 <= len(d) <= 14, _FOR_PHONE)
    each(_LANDLINE, "phone", 0.6, lambda d: 9 <= len(d) <= 13, _FOR_PHONE)
    each(_CARD, "card", 0.6, lambda d: 13 <= len(d) <= 19 and luhn(d), None)


def _names(s: _Spans, names: frozenset[str]) -> None:
    shouting = s.text.isupper()
    named = lambda w: bool(w) and w.lower() in names
    proper = lambda w: bool(w) and w[0].isupper() and not shouting and w[1:2].islower()
    known = not s.words.isdisjoint(names)
    if "a.n" in s.low or not s.words.isdisjoint(_INTRO_HINTS):
        for m in list(_INTRO.finditer(s.text)):
            score = 0.6 - 0.6 * (m["a"].lower() in _ROLES) + 0.3 * (named(m["a"]) or named(m["b"]))
            last = m["b"] and (named(m["b"]) or proper(m["b"]) or score > 0.8)
            if score >= THRESHOLD:
                s.add("person_name", m.start("a"), m.end("b") if last else m.end("i") if m["i"] else m.end("a"), score)
    if not s.words.isdisjoint(_TITLE_HINTS):
        for m in list(_TITLED.finditer(s.text)):
            vague = m["title"].lower() in ("bapak", "ibu", "ms", "mas", "bang", "kak") and not proper(m["c"])
            score = 0.55 - 0.6 * (m["c"].lower() in _ROLES) + 0.3 * named(m["c"]) - 0.3 * vague
            if score >= THRESHOLD:
                s.add("person_name", m.start("c"), m.end("d") if named(m["d"]) else m.end("c"), score)
    pairs = (_SIGNED if "- " in s.low else None, _FROM if "dari" in s.words or "from" in s.words else None)
    for pattern in filter(None, pairs):
        for m in list(pattern.finditer(s.text)):
            both = proper(m["x"]) and proper(m["y"])
            score = 0.55 * both + 0.6 * (named(m["x"]) or named(m["y"])) - 0.6 * (m["x"].lower() in _ROLES)
            if score >= THRESHOLD:
                s.add("person_name", m.start("x"), m.end("y") if m["y"] else m.end("x"), score)
    if known:
        for m in list(_WORD.finditer(s.text)):
            if m[0].lower() in names:
                before = s.text[max(0, m.start() - CONTEXT_CHARS) : m.start()].split()
                if not (before and before[-1].lower().strip("\"'(“") in _NOT_PERSON):
                    s.add("person_name", m.start(), _with_surname(s, m, proper, named), 0.6)


def _with_surname(s: _Spans, name: re.Match, proper, named) -> int:
    """The end of a capitalised name with the capitalised word right after it that the list does not know."""
    follows = _FOLLOWING.match(s.text, name.end())
    return follows.end() if follows and proper(name[0]) and proper(follows["y"]) and not named(follows["y"]) and follows["y"].lower() not in _ROLES else name.end()


def find_personal(text: str, names: frozenset[str]) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every span, by position."""
    s = _Spans(text)
    _emails(s)
    if "@" in s.text or "#" in s.text or "://" in s.text:
        for m in list(_SKIP.finditer(s.text)):
            s.hide(m.start(), m.end())
    if _DIGIT.search(s.text):
        _addresses(s)
        if _DIGITS.search(s.text):
            _numbers(s)
    if not s.words.isdisjoint(_SPELLED_HINTS):
        for m in list(_SPELLED.finditer(s.text)):
            s.add("phone", m.start(), m.end(), 0.8)
    _names(s, names)
    return s.found if len(s.found) < 2 else sorted(s.found, key=lambda x: x[1])


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind in square brackets; adjacent names share one placeholder."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if kind == "person_name" and out and out[-1] == "[PERSON_NAME]" and not text[at:start].strip():
            at = end
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def known_names(names: DataFrame, column: str) -> frozenset[str]:
    """The list of known names, lower-cased; a parameter table that must stay within MAX_NAMES, as every worker holds it."""
    found = names.where(F.col(column).isNotNull()).select(F.lower(F.trim(column)).alias("n")).distinct().limit(MAX_NAMES + 1).collect()
    if len(found) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} known names")
    return frozenset(r.n for r in found if r.n)


def personal_spans(df: DataFrame, key: str, text: str, names: frozenset[str]) -> DataFrame:
    """row_id, kind, start INT, end INT, score: every span of personal information in the texts.

    Null and empty texts have none. Repeated rows are searched each. Texts are searched whole, however long. An empty
    table gives no rows. One narrow stage; columns other than the two are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *span) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for span in find_personal(t, shared.value)]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row_id", "kind", "start", "end", "score"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "row_id bigint, kind string, start int, end int, score double")


def redacted(df: DataFrame, key: str, text: str, names: frozenset[str]) -> DataFrame:
    """row_id, text, n_spans INT: every row with its text redacted; a null text stays null, with no span."""
    shared = df.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1).to_pylist():
                spans = find_personal(t, shared.value) if t else []
                texts.append(redact(t, spans) if spans else t)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["row_id", "text", "n_spans"])

    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "row_id bigint, text string, n_spans int")
