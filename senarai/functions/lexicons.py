"""Word tables that must equal those of the specification for right results.

Identity mappings, entries that can never match a token and repeated entries are left out; where a key had two values,
the effective one, the later, is given.
"""

from __future__ import annotations

#: Colloquial form -> standard form.
SLANG = {
    "gak": "tidak", "ga": "tidak", "nggak": "tidak", "enggak": "tidak", "tdk": "tidak", "gk": "tidak", "tak": "tidak", "tk": "tidak",
    "yg": "yang", "aja": "saja", "krn": "karena", "karna": "karena", "klo": "kalau", "kl": "kalau", "kalo": "kalau", "klu": "kalau",
    "utk": "untuk", "u": "untuk", "dgn": "dengan", "dg": "dengan", "sm": "sama", "dr": "dari", "dlm": "dalam", "dlu": "dulu",
    "tp": "tapi", "tpi": "tapi", "sbnrnya": "sebenarnya", "bgt": "banget", "bangettt": "banget",
    "jd": "jadi", "jg": "juga", "kluarga": "keluarga", "org": "orang", "tmn": "teman", "temen": "teman",
    "skrg": "sekarang", "ntar": "nanti", "kmrn": "kemarin", "km": "kamu", "kmu": "kamu", "sy": "saya", "aq": "aku", "gue": "saya", "gua": "saya",
    "krdt": "kredit", "pinjol": "pinjaman online", "pinjamanonline": "pinjaman online", "bgtu": "begitu", "trus": "terus", "trs": "terus",
    "aps": "aplikasi", "apk": "aplikasi", "app": "aplikasi",
    "blm": "belum", "blum": "belum", "blom": "belum", "belom": "belum",
    "udh": "sudah", "udah": "sudah", "sdh": "sudah", "suda": "sudah",
    "msh": "masih", "msih": "masih", "masi": "masih",
    "lg": "lagi", "lgi": "lagi", "lag": "lagi",
    "bkn": "bukan", "ato": "atau", "ata": "atau", "dngan": "dengan", "untk": "untuk", "dri": "dari",
    "pd": "pada", "pda": "pada", "dlam": "dalam", "k": "ke", "d": "di",
    "smogha": "sangat", "smoga": "semoga", "smg": "semoga",
    "acc": "accept", "accepted": "accept", "approve": "accept",
    "cairkan": "cair", "pencairan": "cair", "prosess": "proses", "process": "proses",
    "cepet": "cepat", "cepatt": "cepat", "fast": "cepat", "easy": "mudah",
    "good": "bagus", "best": "bagus", "okay": "baik", "ok": "baik",
    "jelek": "buruk", "bad": "buruk", "membantu": "bantu", "help": "bantu", "helpful": "bantu",
    "pinjaman": "pinjam", "loan": "pinjam", "batas": "limit", "bung": "bunga", "interest": "bunga",
    "jangkawaktu": "tenor", "jangka": "tenor", "smooth": "lancar", "fail": "gagal", "failed": "gagal",
    "reject": "tolak", "rejected": "tolak", "disappointed": "kecewa", "satisfied": "puas", "satisfaction": "puas",
    "disturb": "ganggu", "complicated": "ribet", "complex": "ribet", "expensive": "mahal", "cheap": "murah",
    "safe": "aman", "secure": "aman", "trustworthy": "amanah", "response": "respon", "respond": "respon",
    "service": "servis", "layanan": "servis", "krem": "keren", "cool": "keren", "awesome": "mantap", "great": "mantap",
    "maknyus": "enak", "delicious": "enak", "bodog": "bodoh", "stupid": "bodoh", "fraud": "penipuan", "scam": "penipuan",
}

#: Words dropped from token lists (words of one or two letters are dropped by their length).
STOPWORDS = (
    "yang dan dari untuk pada dengan atau itu ini jadi karena agar tidak iya sudah ada adalah "
    "aku kamu dia kami kita mereka apa mengapa bagaimana sebuah para oleh dalam gue gua sih deh kok nih tuh nah loh dong "
    "via sebagai bagi bukan kecuali tanpa serta juga boleh mungkin hanya akan telah sedang lagi lah pun kah nya "
    "saya terima kasih makasih thanks thank you mohon tolong please pls semoga smoga smg hopefully "
    "jika kalau kalo klo bisa can could sangat banget bgt very sekali once one also too "
    "udah udh already done belum blm blum still will would has have currently now again more "
    "saja aja just only masih msh msih yet maybe perhaps may harus must should perlu need required "
    "mau want wanna ingin wish able gak nggak enggak tdk tak not bkn ato ata either and plus "
    "dgn with utk for dri from pda dlm dlam this that which lgi"
).split()

#: Affixes in the order they are tried, and words that are never stemmed.
SUFFIXES = ("kan", "i", "an", "lah", "kah", "pun", "ku", "mu", "nya")
PREFIXES = ("meng", "meny", "men", "mem", "me", "peng", "peny", "pen", "pem", "pe", "ber", "be", "ter", "te", "per", "di", "ke", "se")
UNSTEMMED = (
    "sekali penting ting us dan yang ini itu ada jadi akan sudah bisa harus mau ingin perlu boleh mungkin hanya juga saja "
    "lagi masih belum tidak bukan atau dengan untuk dari pada dalam ke di adalah"
).split()

#: Phrases of the sentiment lexicon by valence, as used for the label.
VALENCES = {
    0.25: (
        "sangat bagus", "sangat baik", "sangat puas", "terbaik", "perfect", "sempurna", "awesome", "amazing", "fantastic",
        "brilliant", "excellent", "love", "loved", "loving", "recommended", "recommend", "highly recommend",
    ),
    0.24: ("terlalu bagus", "terlalu baik", "benar-benar bagus", "benar-benar baik"),
    0.20: (
        "bagus", "baik", "mantap", "keren", "suka", "senang", "puas", "great", "good", "nice", "wonderful", "memuaskan",
        "kepuasan", "enjoy", "fun", "enak", "lezat", "nyaman", "mudah", "simple", "praktis", "berhasil", "sukses", "menang",
        "profit", "untung", "benefit", "helpful", "useful", "effective", "efficient", "fast", "cepat", "lancar", "smooth",
        "aman", "safe", "secure", "amanah", "trustworthy",
    ),
    0.15: (
        "ok", "okay", "fine", "alright", "bisa", "boleh", "hampir", "hampir bagus", "lumayan", "cukup", "decent", "acceptable",
        "satisfied", "satisfaction",
    ),
    -0.25: (
        "sangat buruk", "sangat jelek", "sangat kecewa", "sangat menyesal", "sangat gagal", "terburuk", "terlalu buruk",
        "terlalu jelek", "benar-benar buruk", "benar-benar jelek", "terrible", "awful", "horrible", "disgusting", "hate",
        "hated", "hating", "worst", "sucks", "sucked", "sucking", "disappointed", "disappointing",
    ),
    -0.20: (
        "buruk", "jelek", "gagal", "fail", "failed", "failing", "error", "salah", "wrong", "rusak", "broken", "menyesal",
        "kecewa", "regret", "boring", "membosankan", "ribet", "sulit", "difficult", "hard", "complicated", "complex",
        "confusing", "mahal", "expensive", "overpriced", "rugi", "loss", "kerugian", "waste", "lambat", "slow", "delay",
        "terlambat", "late", "menunggu", "waiting", "ganggu", "disturb", "disturbing", "annoying", "frustrating",
        "frustrated", "penipuan", "fraud", "scam", "scamming", "cheat", "cheating", "fake",
    ),
    -0.15: (
        "tidak bagus", "tidak baik", "tidak suka", "tidak senang", "tidak puas", "gak bagus", "ga bagus", "nggak bagus",
        "enggak bagus", "tdk bagus", "bukan bagus", "bukan baik", "bukan suka", "bukan senang", "bukan puas", "so-so", "meh",
    ),
}
#: Fixed value: the score lexicon differs from the label lexicon in this phrase alone (0 for the label).
SCORE_ONLY = {0.15: ("mungkin",)}

#: Substrings that strengthen and that flip a score.
INTENSIFIERS = ("sangat", "banget", "sekali", "terlalu", "benar-benar", "really", "very", "so", "extremely", "highly")
NEGATIONS = ("tidak", "gak", "ga", "nggak", "enggak", "tdk", "gk", "tak", "tk", "bukan", "bkn", "no", "not", "never", "neither", "nor")

#: Words ignored when keywords are learned from corrections.
LEARNING_STOPWORDS = "yang dan di ke dari untuk pada dengan atau itu ini jadi karena agar tidak iya sudah ada adalah".split()

#: Fixed value: the classes, in report order.
LABELS = ("positif", "negatif", "netral")
