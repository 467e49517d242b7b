import heapq
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirespark.llm import encoding as EN
from quirespark.llm import language as LA
from quirespark.llm import mixing as MX
from quirespark.llm import repetition as RE
from quirespark.llm import residue as RS
from quirespark.llm import scans as SC
from quirespark.llm import tokenize as TK
from quirespark.llm import truncation as TR

READ = "reading_id long, job_id string, page_number int, source_key string, lang string, result_format string, content string, language string, encoding_text string, n long"
EN_ = "The clerk of the lower parish copied the register of births near the ferry at Marham. The treasurer of the old chancery weighed the receipts for timber and lime behind the market hall."
FR_ = "Le greffier du domaine forestier a copié l’inventaire du grenier à côté de la chapelle. Le trésorier du district a vérifié le livre de comptes près du bac de la rivière."
DE_ = "Der Küster der alten Kanzlei kürzte das Rechnungsbuch für das Gericht. Der Zöllner der Weberzunft prüfte die Liste der unbezahlten Zölle an der Fähre."
RU_ = "Писарь речной комиссии исправил соглашение по старому спору о меже за бродом. Казначей сиротской кассы проверил список сборов под крышей склада."
PL_ = "Księgowy kasy sierot odczytał kartę tytułową obok kaplicy w Krakowie. Mierniczy zarządu dróg zważył księgę urodzeń przy promie koło wieży."


def readings(spark, rows):
    """Rows given as dicts; what they leave out is null, and columns with clashing names are there."""
    names = [x.split()[0] for x in READ.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], READ)


def ids(df, col="reading_id"):
    return sorted(r[col] for r in df.collect())


EDGE = [
    {"reading_id": 900, "result_format": "text"}, {"reading_id": 901, "result_format": "text", "content": ""}, {"reading_id": 902, "result_format": "markdown", "content": " \n\n "},
    {"reading_id": 903}, {"result_format": "text", "content": "x"}, {"reading_id": 904, "result_format": "json", "content": "null"}, {"reading_id": 905, "result_format": "text", "content": "퟿\U0001f600 \x00\x01"},
]


# --- encoding ------------------------------------------------------------


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "cp1250", "cp437", "cp866", "koi8-r", "mac-roman", "cp850"])
@pytest.mark.parametrize("text", [FR_, DE_, RU_, PL_, "The café’s résumé — “nothing further”."])
def test_utf8_round_trip(wrong, text):
    table = {b: ch for ch, b in EN._to_byte(wrong).items()}
    spoilt = "".join(chr(b) if b < 128 else table[b] for b in text.encode())
    assert EN.suspicious([spoilt])[0]
    fixed, layers, lost = EN.repair(spoilt)
    assert fixed == text and layers == 1 and not lost


@pytest.mark.parametrize(("wrong", "meant"), [("cp1252", "cp1251"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("mac-roman", "cp1251"), ("cp866", "cp1251")])
def test_single_byte_round_trip(wrong, meant):
    spoilt = RU_.encode(meant).decode(wrong)
    fixed, layers, _ = EN.repair(spoilt)
    assert fixed == RU_ and layers == 1


def test_nested_layers_and_parts():
    twice = FR_.encode().decode("cp1252", "ignore").encode("cp1252", "ignore").decode("cp1252")
    double = "trésorier près".encode().decode("latin-1").encode().decode("latin-1")
    assert EN.repair(double)[:2] == ("trésorier près", 2)
    assert EN.repair("Le greffier. Le trÃ©sorier.")[0] == "Le greffier. Le trésorier." and twice


def test_layers_are_peeled_until_none_is_left():
    text = "le trésorier du château près du café"
    spoilt = text
    for _ in range(6):
        spoilt = spoilt.encode().decode("latin-1")
    assert EN.repair(spoilt) == (text, 6, False)


def test_two_tables_in_one_text():
    words = "café château trésorier près général père mère forêt hôtel âge élève".split()
    one = " ".join(w.encode().decode("cp1252", "replace") for w in words)
    two = " ".join(w.encode("cp1251").decode("latin-1") for w in "писарь комиссии исправил старому спору меже бродом казначей сиротской кассы проверил".split())
    fixed, layers, lost = EN.repair(f"{one} {two}")
    assert "château" in fixed and "казначей" in fixed and layers == 2 and not lost


@pytest.mark.parametrize("text", [FR_, DE_, RU_, PL_, EN_, "Ângela de São Brandão assinou a relação em vão.", "Þórdís and Đorđe signed at Ångholm; Ωμέγα καὶ ἄλφα ☼.", "the r€gis†er and cɑnton", "В деревнe Нuзенрецк спuсок", "What?? Really??", "", None])
def test_correct_text_stays(text):
    assert EN.repair(text) == (text, 0, False) or EN.repair(text)[1:] == (0, False)


def test_lost_bytes():
    assert EN.repair("Pr�fung f�r")[2] and EN.repair("f??r die Pr??fung der Stra??e")[2]


FOREIGN = {
    "greek": "λόγος ἄνθρωπος βιβλίον γράμμα πόλις θάλασσα ἥλιος οὐρανός ποταμός δένδρον οἶκος χώρα",
    "hebrew": "ספר מלך עיר דרך בית שמים ארץ מים אור יום לילה כוכב",
    "names": "Åsãø Bøãå Cåãø Døåã Føãå Gåøã Høåã Jåãø Køãå Løåã Måãø Nøåã",
}


@pytest.mark.parametrize("foreign", sorted(FOREIGN))
@pytest.mark.parametrize("meant", ["the café by the ferry, the café", "the clerk’s book, the clerk’s “old” register"])
def test_foreign_words_hide_no_garbled_ones(spark, foreign, meant):
    good = FOREIGN[foreign] + " " + meant
    spoilt = FOREIGN[foreign] + " " + meant.encode().decode("cp1252", "replace").replace("�", "\x9d")
    assert EN.repair(spoilt)[:2] == (good, 1)
    twice = FOREIGN[foreign] + " " + "the café by the ferry".encode().decode("cp1252").encode().decode("cp1252")
    assert EN.repair(twice)[:2] == (FOREIGN[foreign] + " the café by the ferry", 2)
    rows = [{"reading_id": 1, "result_format": "text", "content": spoilt}, {"reading_id": 2, "result_format": "text", "content": FOREIGN[foreign]}]
    assert ids(EN.found(readings(spark, rows))) == [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_suspicious_is_per_text(texts):
    whole = EN.suspicious(texts)
    assert len(whole) == len(texts) and all(bool(EN.suspicious([t])[0]) == bool(w) for t, w in zip(texts, whole, strict=True))


def test_p5_rows(spark):
    rows = [{"reading_id": i, "result_format": "text", "content": c} for i, c in enumerate([FR_, FR_.encode().decode("cp1251", "replace"), DE_.encode().decode("latin-1")] * 2, 1)]
    rows += [{"reading_id": 3, "result_format": "text", "content": DE_.encode().decode("latin-1")}, {"reading_id": 9, "result_format": "text", "content": "a " * 200_000 + "fÃ¼r Ã¼ber"}, {"reading_id": 10, "result_format": "json", "content": "fÃ¼r"}]
    assert ids(EN.found(readings(spark, rows + EDGE))) == [2, 3, 5, 6, 9]
    out = EN.repair_encoding(readings(spark, rows + EDGE))
    assert out.count() == len(rows + EDGE) and out.filter("reading_id = 900").first()["encoding_text"] is None
    assert EN.found(readings(spark, [])).count() == 0


# --- language --------------------------------------------------------------


def corpus(n=12):
    return [{"reading_id": 10_000 + 100 * k + i, "result_format": "text", "lang": code, "content": t, "job_id": f"j{k}", "page_number": i, "source_key": "s"} for k, (code, t) in enumerate([("eng", EN_), ("fra", FR_), ("deu", DE_), ("rus", RU_), ("pol", PL_)]) for i in range(n)]


def test_p2_rows(spark):
    odd = [
        {"reading_id": 1, "result_format": "text", "lang": None, "content": EN_}, {"reading_id": 2, "result_format": "text", "lang": "fra", "content": DE_}, {"reading_id": 3, "result_format": "text", "lang": "eng", "content": f"{EN_} {FR_}"},
        {"reading_id": 4, "result_format": "text", "lang": "eng", "content": f"{EN_} {FR_.split('. ')[0]}."}, {"reading_id": 5, "result_format": "text", "lang": "English", "content": EN_}, {"reading_id": 6, "result_format": "text", "lang": "en-GB", "content": EN_},
        {"reading_id": 7, "result_format": "text", "lang": "eng", "content": "Too few words."}, {"reading_id": 8, "result_format": "text", "lang": "fra", "content": FR_.encode().decode("cp1252", "replace")}, {"reading_id": 9, "result_format": "text", "lang": "eng+fra", "content": EN_},
    ]
    got = {(r["reading_id"], r["lang_code"]) for r in LA.found(readings(spark, corpus() + odd + odd + EDGE)).collect() if r["reading_id"] and r["reading_id"] < 100}
    assert got == {(1, "en"), (2, "de"), (3, "en"), (3, "fr"), (9, "en")}


def test_mixture_by_em():
    lik = np.log(np.array([[0.9, 0.1, 0.0001], [0.8, 0.2, 0.0001], [0.0001, 0.0002, 0.9]]))
    pi, keep = LA.mixture(lik, penalty=1.0)
    assert keep == [0, 2] and abs(pi.sum() - 1) < 1e-6
    assert LA.mixture(lik[:2])[1] == [0]


def test_sentences_may_begin_with_a_number():
    assert len(LA.sentences("Der Küster prüfte es in Falsinbüll. 7 марта 1873 года писарь подписал.")) == 2
    assert len(LA.sentences("Der Küster prüfte Blatt Nr. 7 im Dorf.")) == 1 and len(LA.sentences("Писарь подписал лист с. 5 в городе.")) == 1


def test_responsibilities_share_out_doubtful_sentences():
    lik = np.log(np.array([[0.9, 0.05], [0.9, 0.05], [0.4, 0.41], [0.02, 0.98]]))
    pi, keep = LA.mixture(lik, penalty=0.5)
    share = LA.responsibilities(lik, pi, keep)
    assert keep == [0, 1] and share[2, 0] > 0.5 and abs(share.sum() - 4) < 1e-9 and round(share[:, 1].sum()) == 1


def test_other_languages_are_rejected():
    model = LA.fit([(t, c) for c, t in (("en", EN_), ("fr", FR_), ("de", DE_), ("ru", RU_), ("pl", PL_))] * 20)
    out = LA.infer(model, ["Ο γραμματέας της κάτω ενορίας αντέγραψε το μητρώο γεννήσεων κοντά στο πλοίο.", f"{EN_} {EN_}"])
    assert out[0]["languages"] == [] and out[0]["segments"][0]["lang"] == "und" and out[1]["languages"] == ["en"]


def test_p2_rows_of_texts_in_no_language(spark):
    greek = "Ο γραμματέας της κάτω ενορίας αντέγραψε το μητρώο γεννήσεων κοντά στο πλοίο."
    odd = [{"reading_id": 1, "lang": "eng", "content": greek}, {"reading_id": 2, "lang": None, "content": greek}, {"reading_id": 3, "lang": "ell", "content": greek}, {"reading_id": 4, "lang": "eng", "content": f"{DE_} {DE_}"}]
    df = readings(spark, corpus() + [{"result_format": "text"} | r for r in odd])
    told = LA.identify_languages(df.select("reading_id", "lang", "content")).filter("language.n_words >= 10 AND size(language.languages) = 0")
    assert ids(told) == [1, 2, 3]
    assert [(r["reading_id"], r["lang_code"]) for r in LA.found(df).collect() if r["reading_id"] < 100] == [(4, "de")]


def test_held_out_accuracy():
    texts = [(t, LA.LANGUAGES.index(c)) for c, t in (("en", EN_), ("fr", FR_), ("de", DE_), ("ru", RU_), ("pl", PL_))]
    model = LA.fit([(t, LA.LANGUAGES[k]) for t, k in texts])
    out = LA.infer(model, ["The ferry of the parish clerk.", "la chapelle du greffier forestier", "die Liste der Kanzlei", "список старому спору", "karta urodzeń obok kaplicy", None, "123"])
    assert [o["languages"][:1] for o in out] == [["en"], ["fr"], ["de"], ["ru"], ["pl"], [], []]


def test_empty_tables(spark):
    e = readings(spark, [])
    for f in (LA.found, RE.found, TR.found, SC.found, TR.by_source):
        assert f(e).count() == 0
    assert RE.perplexity_bands(e).count() == 0


# --- repetition ------------------------------------------------------------


def share(text):
    w = re.findall(r"[^\W\d_]+", text.lower())
    seen, rep = set(), [False] * len(w)
    for i in range(len(w) - 3):
        k = tuple(w[i : i + 4])
        if k in seen:
            rep[i : i + 4] = [True] * 4
        seen.add(k)
    return sum(rep) / len(w) if w else 0.0


def test_repeated_share_is_exact(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(0, 60))) for _ in range(300)] + [EN_ + " " + EN_, None, "", "one two three", "x " * 50_000]
    df = readings(spark, [{"reading_id": i, "result_format": "text", "content": t} for i, t in enumerate(texts)])
    got = {r["reading_id"]: r["repetition"] for r in RE.repetition(df).select("reading_id", "repetition").collect()}
    for i, t in enumerate(texts):
        assert abs(got[i]["repeated_share"] - share(t or "")) < 1e-9
    assert got[300]["adapted_perplexity"] < 2 * got[300]["perplexity"] and got[301]["perplexity"] is None
    assert ids(RE.found(df)) == [i for i, t in enumerate(texts) if share(t or "") >= 0.25]


def test_garbled_copy_counts_as_it_should_read(spark):
    text = f"{FR_} {FR_.encode().decode('latin-1')}"
    assert ids(RE.found(readings(spark, corpus() + [{"reading_id": 1, "result_format": "text", "content": text}] * 2 + EDGE))) == [1]


def test_model_is_a_distribution(spark):
    texts = [EN_, EN_[:120], FR_, "the clerk of the ferry", "the treasurer of the parish of the clerk"]
    model = RE.train(spark.createDataFrame([(t,) for t in texts], "t string"), "t", kinds=(RE.WORD, RE.BIGRAM, RE.TRIGRAM, RE.WORD_BACKOFF, RE.BIGRAM_BACKOFF))
    words = RE.Words()
    vocabulary = words(sorted({w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower())}))
    asked = {}
    for ctx in (["of", "the"], ["the", "clerk"], ["le", "ferry"]):
        a, b = words(ctx)
        for w in vocabulary:
            asked[(*ctx, w)] = [(RE.TRIGRAM, RE.mixed(RE.mixed(a, b), w)), (RE.BIGRAM_BACKOFF, RE.mixed(a, b)), (RE.BIGRAM, RE.mixed(b, w)), (RE.WORD_BACKOFF, b), (RE.WORD, w)]
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    rows = {(kind, signed(k)) for x in asked.values() for kind, k in x}
    p = {(r["kind"], r["key"]): r["p"] for r in RE.look_up(spark.createDataFrame(sorted(rows), "kind int, key long"), model).collect()}
    assert len(p) == len(rows)
    totals = Counter()
    for (a, b, _), x in asked.items():
        three, back3, two, back2, one = (p[kind, signed(k)] for kind, k in x)
        two = two if two is not None else (back2 or 0) + one if one is not None else None
        lp = three if three is not None else (back3 or 0) + two if two is not None else None
        totals[a, b] += 2**lp if lp is not None else 0
    assert all(abs(t - 1) < 1e-3 for t in totals.values()) and len(totals) == 3


def test_look_up_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(RE, "SHARD_ROWS", 20)
    model = RE.train(spark.createDataFrame([(EN_,), (FR_,)], "t string"), "t", kinds=(RE.WORD,))
    assert model.bits >= 2
    words = RE.Words()(["the", "clerk", "le", "nowhere"])
    rows = [(RE.WORD, w - (1 << 64) if w >> 63 else w) for w in words]
    got = {r["key"]: r["p"] for r in RE.look_up(spark.createDataFrame(rows * 3, "kind int, key long"), model).collect()}
    assert [got[k] is None for _, k in rows] == [False, False, False, True]


def test_hot_contexts_are_joined_in_parts(spark):
    many = spark.range(100).selectExpr("id % 3 AS k", "id AS s")
    one = many.groupBy("k").agg(F.count("*").alias("n_rows"), F.max("s").alias("top"))
    got = RE.joined_in_parts(many, one, "k", "s", hot_rows=10)
    assert got.count() == 100 and {(r["k"], r["top"]) for r in got.collect()} == {(0, 99), (1, 97), (2, 98)}


def test_bands_reject_before_the_share_verifies(spark):
    third = EN_.split(". ")[0]
    rows = corpus() + [{"reading_id": 1, "result_format": "text", "lang": "eng", "content": f"{EN_} {EN_}"}, {"reading_id": 2, "result_format": "text", "lang": None, "content": f"{FR_} {DE_} {RU_} {PL_} {third} {' '.join(third.split()[:5])}"}]
    got = {r["reading_id"]: r for r in RE.judged(readings(spark, rows + EDGE)).collect()}
    assert got[1]["ratio"] < got[1]["lower_ratio"] < 1 and got[1]["band_lang"] == "en"
    assert got[2]["ratio"] > got[2]["lower_ratio"] and got[2]["band_lang"] == "und" and set(got) == {1, 2}


# --- truncation ---------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "fmt", "state"),
    [
        (EN_, "text", "whole"), (EN_[:100], "text", "cut"), (EN_[:100] + "...", "text", "cut"), (f"{EN_}\n\n- 94 -", "text", "whole"), (f"{EN_}\nTHE MARHAM GAZETTE", "text", "whole"), ("Copy No. 4", "text", "whole"),
        (f"{EN_} The plan of bridge No.", "text", "cut"), ("[1, 2", "json", "cut"), ("[1, 2]", "json", "whole"), ('{"a": "b', "json", "cut"), ("a,b\n1,2\nx", "csv", "cut"), ("a,b\n1,2\nx,3", "csv", "whole"), ("n,a,e\nx,721,72", "csv", "cut"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "markdown_table", "whole"), ("| a | b |\n|---|---|\n| 1 | 2", "markdown_table", "cut"), (None, "text", "whole"), ("", "csv", "whole"), (f"{EN_}\n\nMarham ........ 55", "text", "whole"),
    ],
)
def test_states(text, fmt, state):
    assert TR.state(text, fmt)[0] == state


def test_p4_rows(spark):
    sign = [{"reading_id": 1000 + i, "result_format": "text", "content": f"{t}\n\nSigned, for the {n} archive"} for i, (t, n) in enumerate([(EN_, "Marham"), (EN_, "Welford")] * 6)]
    cut = [{"reading_id": 1, "result_format": "text", "content": EN_[:-30]}, {"reading_id": 2, "result_format": "text", "content": f"{EN_}\nThe clerk of the"}, {"reading_id": 2, "result_format": "text", "content": f"{EN_}\nThe clerk of the"}, {"reading_id": 3, "result_format": "text", "content": EN_[:-1] + " and more " * 30_000}]
    df = readings(spark, corpus() + sign + cut + EDGE)
    got = [x for x in ids(TR.found(df.filter("reading_id IS NOT NULL"))) if x < 900]
    assert got == [1, 2, 3]
    assert TR.align(EN_[:80], EN_) == "cut" and TR.align(EN_, EN_) is None and TR.align("other words stand here now", EN_) is None
    assert {r["source_key"]: r["n_cut"] for r in TR.by_source(df).collect()}["s"] == 0


def test_p4_tries_other_copies(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdefghiklmnoprstuvw", k=rnd.randint(5, 9))) for _ in range(3000)]
    rows, want = [], []
    for g in range(12):
        words = rnd.choices(vocabulary, k=150)
        whole = " ".join(words)
        # as many words as the whole copy: the hash decided which of them is the longer
        rows += [{"content": whole + "."}, {"content": whole[:-2]}]
        want.append(len(rows))
        # the longest is misread at the end of the cut one, or ends otherwise; only the second longest verifies
        words = rnd.choices(vocabulary, k=150)
        whole = " ".join(words)
        cut = whole[: len(whole) - len(" ".join(words[-4:])) + 2]
        misread = whole.replace(cut[-12:-6], "######") + " with more words of the other edition."
        rows += [{"content": whole + "."}, {"content": misread}, {"content": cut}]
        want.append(len(rows))
    rows = [{"reading_id": i, "result_format": "text"} | r for i, r in enumerate(rows, 1)]
    aligned = TR.truncation(readings(spark, rows)).filter("evidence = 'aligned'")
    assert ids(aligned) == want
    assert TR.verified(EN_[:79], EN_) == "cut" and TR.verified(EN_[: EN_.index(" near")], EN_) == "cut" and TR.verified("## Marham, 1850", f"## Marham, 1850\n\n{EN_}") is None and TR.verified("The Rolls of Marham Parish Church", f"The Rolls of Marham Parish Church\n\n{EN_}") == "on" and TR.verified(EN_[: EN_.index(".") + 1], EN_) == "closed"


def test_marks_are_shared():
    rnd = random.Random(6)
    text = "".join(rnd.choices("abcdef gяλ", k=500))
    held = set(TR.marks(text).tolist())
    assert all(set(TR.marks(text[i : i + TR.TAIL]).tolist()) <= held for i in range(500 - TR.TAIL + 1)) and not len(TR.marks("short")) and len(TR.marks(text[: TR.TAIL])) == 1


def test_row_and_value_ends():
    table = "| a | b |\n|---|---|\n| one two three four five six | 2 |\n| seven eight | 34 |"
    assert TR.verified(table[:-9], table, "markdown_table") == "cut" and TR.verified(table[: table.rindex("\n")], table, "markdown_table") == "on"


def test_min_hash_brings_copies_together():
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    a = " ".join(rnd.choice(words) for _ in range(150))
    keys = TR.min_hash(RE.Words(), [a, a + " end", "few words", None, " ".join(rnd.choice(words) for _ in range(150))])
    assert (keys[0] == keys[1]).any() and not (keys[0] == keys[4]).any() and not keys[2].any()


def shingles(text):
    w = re.findall(r"\w+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("part", [0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95])
def test_cut_copies_meet_their_whole_ones(part):
    """Recall of the bands and of the alignment on copies cut at ``part`` of the length, 2 % of their words misread."""
    rnd = random.Random(int(part * 100))
    vocabulary = ["".join(rnd.choices("abcdefghiklmnoprstuvw", k=rnd.randint(2, 9))) for _ in range(2000)]
    whole, cut = [], []
    for _ in range(300):
        w = rnd.choices(vocabulary, k=rnd.randint(60, 200))
        text = " ".join(w) + "."
        copy = " ".join("".join(rnd.sample(x, len(x))) if rnd.random() < 0.02 else x for x in w)[: int(part * len(text))]
        whole.append(text)
        cut.append(copy)
    keys = TR.min_hash(RE.Words(), whole + cut)
    meet = (keys[:300] == keys[300:]) & (keys[:300] != 0)
    assert meet.any(axis=1).mean() >= 0.9
    near = [(a, b) for a, b in zip(cut, whole, strict=True) if len(shingles(a) & shingles(b)) >= TR.SIMILARITY * len(shingles(a))]
    assert len(near) > 150 and np.mean([TR.align(a, b) == "cut" for a, b in near]) >= 0.9


def test_runs_cover_whole_texts(monkeypatch):
    rnd = random.Random(7)
    vocabulary = [f"w{i}ä" for i in range(400)]
    words = [rnd.choices(vocabulary, k=n) for n in (TR.RUN - 1, TR.RUN, TR.RUN + 4, 60, 900)]
    texts = [None, "", " ", *(" ".join(w) for w in words), "x " * 50_000]
    keys = TR.runs(texts).to_pylist()
    assert [len(k) for k in keys[:6]] == [0, 0, 0, 0, 1, 5] and len(keys[-1]) == 1 and 140 < len(keys[7]) < 260
    n = TR.RUN + TR.SPAN - 1
    parts = [f"Other head {i}\n\n{' - '.join(words[-1][i : i + n]).upper()} and\x00an end" for i in range(900 - n + 1)]
    assert all(set(k) & set(keys[7]) for k in TR.runs(parts).to_pylist())
    monkeypatch.setattr(TR, "BLOCK", 64)
    assert TR.runs(texts).to_pylist() == keys


def test_likely_texts_hold_all_wanted_ones(spark):
    df = spark.range(20_000).selectExpr("unhex(md5(string(id))) digest", "id")
    wanted = df.filter("id % 40 = 7")
    got = {r["id"] for r in TR._likely(df, wanted).collect()}
    assert got >= set(range(7, 20_000, 40)) and len(got) < 600 and TR._likely(df, wanted.limit(0)).count() == 0


def test_p4_copies_with_other_beginnings(spark):
    """The beginning of the cut copy is another, is missing, or stands behind more words in the whole one; only the copy tells that it is cut."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("abcdefghiklmnoprstuvw", k=rnd.randint(5, 9))) for _ in range(3000)]
    rows, want = [], []
    for g in range(12):
        lines = [",".join(rnd.choices(vocabulary, k=3)) for _ in range(60)]
        other = [",".join(rnd.choices(vocabulary, k=3)) for _ in range(9)]
        cut, whole = [(other + lines[9:], lines), (lines[9:], lines), (lines, other + lines)][g % 3]
        rows += [{"content": "\n".join(whole)}, {"content": "\n".join(cut[:-2])[:-2]}]
        want.append(len(rows))
    df = readings(spark, [{"reading_id": i, "result_format": "csv"} | r for i, r in enumerate(rows, 1)])
    assert ids(TR.truncation(df).filter("evidence = 'aligned'")) == want == ids(TR.found(df))
    words = rnd.choices(vocabulary, k=120)
    misread = " ".join([*words[:-3], words[-3][:-1] + "#", words[-2], words[-1][:-3]])
    assert TR.verified(misread, f"{' '.join(rnd.choices(vocabulary, k=80))} {' '.join(words)} and more") == "cut"


def test_closing_words_decide(spark):
    wrapped = [{"reading_id": 2000 + i, "result_format": "text", "content": f"The roll of the\nparish {w} was read\nby the clerk."} for i, w in enumerate("abcdefghijkl")]
    heads = [{"reading_id": 3000 + i, "result_format": "text", "content": f"The book of Marham\n\nThe {w} was read by the clerk.\n\nThe book of Marham"} for i, w in enumerate("abcdefghijkl")]
    cut = [{"reading_id": 1, "result_format": "text", "content": "All was read here.\n\nThe book of the"}]
    got = {r["reading_id"]: r["evidence"] for r in TR.truncation(readings(spark, wrapped + heads + cut)).collect()}
    assert got[1] == "closing" and {got[r["reading_id"]] for r in wrapped + heads} == {None}


# --- scans ----------------------------------------------------------------------


def test_p7_rows(spark):
    page = lambda i, t: {"reading_id": i, "job_id": "job", "page_number": i, "result_format": "text", "content": t}
    rows = [page(i, f"ANNALS OF MARHAM\n\nThe clerk number {w} copied the roll of the parish.\nHe left.") for i, w in ((1, "one"), (2, "two"))] + [page(3, "ANNA1S OF MARHAM    - 12 -\nThe clerk of the parish weighed it.\nHe went.")]
    rows += [page(4, "The regi-\nster of births was lost.\nAll is well."), page(5, "The w1nter sess!on of the c€nsus was long and the paper was old.\nHe went."), page(6, "The procès-verbal was read.\nHe went."), page(7, "The procès-\nverbal was lost.\nHe went.")]
    rows += [page(8, "One line here.\nHe went.\n\n[14]"), page(11, "The session was here. All went on."), page(9, "12"), page(10, f"{EN_}\n{EN_}\n[14]"), page(4, "The regi-\nster of births was lost.\nAll is well.")]
    got = sorted(tuple(r) for r in SC.found(readings(spark, rows + corpus() + EDGE)).filter("reading_id < 100").collect())
    assert got == [(1, "running_header"), (2, "running_header"), (3, "page_number"), (3, "running_header"), (4, "hyphen_break"), (5, "misread_characters"), (8, "page_number")]
    clean = {r["reading_id"]: r["clean_text"] for r in SC.paragraphs(readings(spark, rows + corpus() + EDGE)).select("reading_id", "clean_text").collect()}
    assert clean[1].startswith("The clerk number one") and "register of births" in clean[4] and "session" in clean[5] and clean[8] == "One line here. He went." and clean[900] is None


def test_misread_tokens():
    assert all(map(SC.misread, ["l0wer", "gu!lde", "F|rühjahr", "r€gister", "cɑnton", "Нuзенрецк", "wei9hed", "5pisali"]))
    assert not any(map(SC.misread, ["4th", "1850-х", "n.º", "fol.", "12r", "don’t", "Marham,", "1:½", "A4", "—", "№"]))


def test_channel_is_learnt_and_the_path_decides(spark):
    texts = ["the lower parish", "the lower tower", "a lower parish stands", "a tower stands", "the parish tower"] * 3 + ["the l0wer t0wer", "a l0wer par!sh", "the t0wer", "the tow€r", "B2B"]
    model = RE.train(spark.createDataFrame([(t,) for t in texts], "t string"), "t", kinds=(RE.WORD, RE.BIGRAM, RE.WORD_BACKOFF))
    pages = spark.createDataFrame([(1, ["the l0wer t0wer", "a l0wer par!sh"]), (2, ["the t0wer", "the tow€r"]), (3, ["the tow0er", "B2B", "x9q7z 4th"])], "reading_id long, lines array<string>")
    channel = SC.learn_channel(pages, model)
    assert channel.readings(False, "0")[0][0] == "o" and channel.readings(False, "€")[0][0] == "e" and channel.readings(False, "!")[0][0] == "i"
    assert len(channel.readings(False, "7")) > 50  # no evidence: every letter alike
    got = {r["reading_id"]: (r["changed"], {x["line"]: x["fixed"] for x in r["fixes"]}) for r in SC.decoded(pages, model, channel).collect()}
    assert got[1] == (4, {"the l0wer t0wer": "the lower tower", "a l0wer par!sh": "a lower parish"})
    assert got[2] == (2, {"the t0wer": "the tower", "the tow€r": "the tower"}) and got[3][1] == {"the tow0er": "the tower", "x9q7z 4th": "x9q7z 4th"}  # no known word: it counts and keeps its signs


def test_shapes_of_the_same_script_are_learnt(spark):
    good = "Der Küster unterschrieb dawnej budowle derrière la halle, and the number was forwarded behind the customs house."
    rows = [{"reading_id": i, "job_id": "j", "page_number": i, "result_format": "text", "content": good} for i in range(30)]
    bad = ["The riumber was forwarcled behirid it.", "The nurnber was forwardcd behind it.", "Der Kiister uriterschrieb dcrrière la halle.", "The nutnber of Margate, an Ostler."]
    rows += [{"reading_id": 100 + i, "job_id": "k", "page_number": i, "result_format": "text", "content": t} for i, t in enumerate(bad)]
    df = readings(spark, rows + EDGE)
    got = {(r["reading_id"], r["word"]): r["printed"] for r in SC.misread_shapes(df.select("reading_id", "content")).collect()}
    assert got[100, "riumber"] == "number" and got[100, "forwarcled"] == "forwarded" and got[100, "behirid"] == "behind" and got[101, "nurnber"] == "number" and got[102, "dcrrière"] == "derrière"
    assert not any(w in ("nutnber", "margate", "ostler", "number") for _, w in got)
    clean = {r["reading_id"]: r["clean_text"] for r in SC.paragraphs(df).collect()}
    assert clean[100] == "The number was forwarded behind it." and clean[103] == bad[3] and clean[5] == good and clean[900] is None


def test_many_signs_and_long_compounds():
    assert not SC.doubtful("1!2€3|4") and SC.doubtful("par!sh") and not SC.doubtful("1st")
    channel = SC.channel_of([(False, "0", "o", 5.0), (False, "0", "e", 5.0)])
    assert len(SC.candidates("b0b0b0b0b0b0b0b", channel)) == 2**7
    long = "a" * 60
    assert SC.compounds(f"the {long}-{long} stood") == [f"{long}-{long}"] and SC.breaks(f"the {long}-\n{long} stood") == [(long, "-", long)]


def test_inline_compounds_keep_their_hyphen(spark):
    rows = [{"reading_id": i, "job_id": "j", "page_number": i, "result_format": "text", "content": t} for i, t in enumerate(["A well-known clerk read it.\nHe went.", "The well-\nknown clerk read it.\nHe went.", "The regi-\nster was read.\nHe went."], 1)]
    clean = {r["reading_id"]: r["clean_text"] for r in SC.paragraphs(readings(spark, rows + corpus())).collect()}
    assert clean[2].startswith("The well-known clerk") and clean[3].startswith("The register")


# --- tokenizer ------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(TK.DEFAULT))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def own():
    return TK.Bpe(TK.vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdeinorst '\n1", max_size=80), st.text(alphabet="аеионтсъѣ 7—", max_size=50)))
def test_ids_equal_the_library(library, own, text):
    flat, sizes = own.encode([text])
    assert flat.tolist() == library.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(flat)]


def test_pairs_that_fail_are_merged(own):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(12)) for i in range(800)]
    own.learn([w for w in words if w not in own.index])
    assert all(own.flat[own.index[w]].tolist() == own.merge(w.encode()) for w in words)
    assert any(own.propose(w.encode()) != own.merge(w.encode()) for w in words)


def test_p8_edges(spark, library):
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|> a"), (5, "word " * 40_000), (5, "x"), (6, "\r\n\t é́")]
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in TK.encode(df).collect()]
    assert got[0] == (1, []) and got[1] == (2, [])
    for (a, t), (b, i) in zip(rows, got, strict=True):
        assert a == b and i == library.encode(t or "", add_special_tokens=False).ids
    assert TK.encode(df.limit(0)).count() == 0
    assert TK.encode(df, null_ids=None).filter("doc_id = 1").first()["ids"] is None


# --- mixing ------------------------------------------------------------------------


def naive(weights, seats):
    out, heap = [0] * len(weights), [(-w, i) for i, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8), st.integers(0, 300))
def test_sainte_lague(weights, seats):
    got = MX.sainte_lague([float(w) for w in weights], seats)
    want = naive([float(w) for w in weights], seats)
    assert sum(got) == sum(want)
    key = lambda seats_: sorted(w / (2 * q - 1) for w, n in zip(weights, seats_, strict=True) for q in range(1, n + 1))
    assert np.allclose(key(got), key(want))


def test_mix(spark):
    rnd = random.Random(2)
    docs = [(i, s, "word " * rnd.randrange(20, 60)) for i, s in enumerate(["Big Source"] * 3000 + ["small"] * 40 + ["MID "] * 400)] + [(5000, None, "x"), (5001, "small", None), (5002, "small", ""), (0, "Big Source", "dup")]
    documents = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, source string, text string, shard string")
    targets = spark.createDataFrame([("m", "big_source", 0.5, 1), ("m", "small", 0.2, 5), ("m", "mid", 0.3, 3), ("e", "none", 1.0, 2), ("e2", "none", 0.5, 2), ("e2", "small", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int")
    chosen = MX.mix(documents, targets)
    most = {(r["mix_name"], r["source"]): r["m"] for r in chosen.groupBy("mix_name", "source").agg(F.max("n_times").alias("m")).collect()}
    assert most[("m", "small")] == 5 and most[("m", "big_source")] == 1 and ("e", "none") not in most
    assert chosen.groupBy("mix_name", "doc_id").count().filter("count > 1").count() == 0
    got = {(r["mix_name"], r["source"]): r["actual_share"] for r in MX.shares(documents, targets).collect()}
    assert abs(got[("m", "big_source")] - 0.5) < 0.02 and abs(got[("m", "small")] - 0.2) < 0.02 and got[("e", "none")] == 0 and got[("e2", "small")] == 1
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, MX.mix(documents.repartition(7), targets).collect()))
    assert MX.mix(documents.limit(0), targets).count() == 0 and MX.mix(documents, targets.limit(0)).count() == 0


# --- residue -------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Dear {{ name }},\n\nwelcome.", ["placeholder"]), (f"{EN_} The clerk of ${{county}} wrote.", ["placeholder"]), ("Held at: [INSERT SHELFMARK]", ["placeholder"]), ("Report by __AUTHOR__", ["placeholder"]), ("The <YOUR NAME HERE> signed.", ["placeholder"]),
        ("The guide explains that ${HOME} and {{ title }} are replaced.", []), ("The name template writes `{page}` into files.", []), ("```yaml\nlang: ${LANG}\n```\nA guide.", []), ("<|endoftext|> <s> [INST] </s>", []), ("A <b>bold</b> word <title>x</title>", []),
        ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.", ["filler"]), ("The binder printed lorem ipsum on a sheet.", []), ("asdf asdf jkl qwer", ["filler"]), ("Text text text text. ", ["filler"]), ("Hier steht ein Blindtext, er wird noch ersetzt.", ["filler"]), ("```yaml\na: 1\n #{name} b: 2\n```", ["placeholder"]), ("404 Not Found\nThe requested page could not be found.", ["error"]),
        ("Traceback (most recent call last):\n  File \"a.py\", line 1\nValueError: x", ["error"]), ("Pages 403, 404 and 500 of the volume were not found on the shelf.", []), ("Canvas 12 answered with a 404, so the fetch went on with canvas 13. " + EN_, []),
        ("Please enable JavaScript to view this page.", ["script"]), ("Readers who switch JavaScript off still see the page.", []), ("Checking your browser before accessing the scans.", ["script"]), (None, []), ("", []), ("  ", []), (EN_ * 500, []), ("{", []),
    ],
)
def test_residue(text, kinds):
    assert RS.residue(text) == kinds


@pytest.mark.parametrize(
    ("piece", "kind"),
    [("HTTP 503 Service Unavailable\nTry again later.", "error"), ("Traceback (most recent call last):\n  File \"a.py\", line 1\nValueError: x", "error"), ("Please enable JavaScript to view this page.", "script"), ("Held at: [INSERT SHELFMARK]", "placeholder"), ("Hier steht ein Blindtext, er wird noch ersetzt.", "filler")],
)
@pytest.mark.parametrize("size", [0, 300, 5_000, 50_000])
def test_residue_anywhere_in_a_text_of_any_length(piece, kind, size):
    page = "\n\n".join([EN_] * (size // len(EN_) + 1)) if size else ""
    assert RS.residue(f"{page}\n\n{piece}\n\n{page}") == [kind] and RS.residue(f"{page}\n\n{page}") == []


def test_messages_that_are_spoken_about():
    for text in (f"{EN_}\n\nThe page then shows:\n\nHTTP 503 Service Unavailable", f"{EN_}\n\n```\nTraceback (most recent call last):\n  x\n```\n\n{EN_}", f"{EN_}\n\n404\n\n405\n\n{EN_}", f"{EN_}\n\nAccess to the tower was denied to the surveyor."):
        assert RS.residue(text) == []


def test_p10_rows(spark):
    df = spark.createDataFrame([(1, "Dear ${name},", "r"), (1, "Dear ${name},", "r"), (2, None, "r"), (3, EN_, None), (4, "", "r")], "doc_id long, text string, residue string")
    assert ids(RS.found(df), "doc_id") == [1] and RS.found(df.limit(0)).count() == 0
    assert ids(RS.without_residue(df), "doc_id") == [2, 3, 4]


def test_counts_of_the_corpus_are_whole(spark):
    df = spark.createDataFrame([("a b c a b",), ("a b",), (None,)], "t string").repartition(3)
    grams = df.select("t").mapInArrow(RE._count, RE.GRAMS).groupBy("ord", "key").agg(F.sum("n").alias("n"))
    got = Counter({r["ord"]: r["s"] for r in grams.groupBy("ord").agg(F.sum("n").alias("s")).collect()})
    assert got == {2: 5, 3: 3}
