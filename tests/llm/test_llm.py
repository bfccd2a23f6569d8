"""Training-data operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import hashlib
import random
import sys
import textwrap
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sarnai.llm import chat, common, html_extract, langid, licenses, media, mixing, packing, quality, simhash, tokens, toxicity
from sarnai.llm.tokens import ByteLevel

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", " \n\t", "A b c", "a B c", "a b", "x", "é ü\n\né ü", "日本 語 word " * 40, "one two three four five six seven eight " * 3, "solo " * 30, "w" * 50_000]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else f"s{i % 2}", None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, "A b c", "en", None, 1)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words_of(text):
    return (text or "").encode().split()


def brute_repeats(words):
    at = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if at[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(hit)


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
@settings(max_examples=200, deadline=None)
def test_repeated_words(words):
    assert quality.repeated_words(words) == brute_repeats(words)


def test_quality_counts(odd):
    for r in quality.measure_quality(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        text, ws = r["text"] or "", words_of(r["text"])
        assert r["n_words"] == len(ws)
        assert r["word_chars"] == sum(len(w.decode()) for w in ws)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        lines = text.split("\n")
        assert r["n_dup_lines"] == sum(bool(words_of(x)) and x in lines[:i] for i, x in enumerate(lines))
        assert r["n_repeat_words"] == brute_repeats(ws)
        assert r["base_failed"] == (len(ws) < 20 or 100 * r["n_repeat_words"] > 30 * len(ws))
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_labelled_good(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.measure_quality(small).join(labels, "doc_id").where("not base_failed and quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()
    assert rows[0] > 0.95


# From the first article of the Universal Declaration of Human Rights, written from memory.
CLEAN = {
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.",
    "yo": "Gbogbo ènìyàn ni a bí ní òmìnira; iyì àti ẹ̀tọ́ kọ̀ọ̀kan sì dọ́gba. Wọ́n ní ẹ̀bùn ti làákàyè àti ti ẹ̀rí-ọkàn, ó sì yẹ kí wọn ó máa hùwà sí ara wọn gẹ́gẹ́ bí ọmọ ìyá.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "sk": "Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a majú navzájom jednať v bratskom duchu.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
    "az": "Bütün insanlar ləyaqət və hüquqlarına görə azad və bərabər doğulurlar. Onların şüurları və vicdanları var və bir-birlərinə münasibətdə qardaşlıq ruhunda davranmalıdırlar.",
    "ee": "Wodzi amegbetɔwo katã ablɔɖeviwoe eye wodzena bubu kple gomekpɔkpɔ sɔsɔe. Susu kple dzitsinya le wo dometɔ ɖe sia ɖe si eyata wodze be woanɔ anyi le ɖekawɔwɔ blibo me.",
    "nv": "Bila'ashda'ii t'áá ałtsoh yiník'ehgo bidizhchįh dóó aheełt'éego ílį́į́go bee baahóchįʼ. Eíí hanítshakees hwiihdaasyaʼ dóó hánítshakees ádaat'éego ałkʼéí daniidlį́įgo ałhaa áháyą́ą dooleeł.",
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
    "zu": "Bonke abantu bazalwa bekhululekile belingana ngesithunzi nangamalungelo. Bahlanganiswe wumcabango nangunembeza futhi bafanele baphathane ngomoya wobunye.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "mn": "Хүн бүр төрж мэндлэхэд эрх чөлөөтэй, адилхан нэр төртэй, ижил эрхтэй байдаг. Оюун ухаан, нандин чанар заяасан хүн гэгч өөр хоорондоо ахан дүүгийн үзэл санаагаар харьцах учиртай.",
    "xal": "Күн әмтн төрхлә, тана мөн чинртә, эдл-уушар күцц, мөн эркәрн тедү болн хөөннь. Эдн ухан болн нүл-килнцәс зөвтә, тер учрар эдн негн-негәнләрн ахнр-дүүнр кевтә бәәх зөвтә.",
    "kk": "Барлық адамдар тумысынан азат және қадір-қасиеті мен кұқықтары тең болып дүниеге келеді. Адамдарға ақыл-парасат, ар-ождан берілген, сондықтан олар бір-бірімен туыстық, бауырмалдық қарым-қатынас жасаулары тиіс.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "grc": "Ἅπαντες οἱ ἄνθρωποι ἐλεύθεροι καὶ ἴσοι ἀξίᾳ καὶ δικαιώμασι πεφύκασιν. λόγον δ᾽ ἔχοντες καὶ συνείδησιν ἀλλήλοις ὀφείλουσιν ἀδελφικῶς προσφέρεσθαι καὶ χρῆσθαι τῷ βίῳ.",
    "hy": "Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ ու իրավունքներով։ Նրանք ունեն բանականություն ու խիղճ և միմյանց պետք է եղբայրաբար վերաբերվեն։",
    "ka": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით. მათ მინიჭებული აქვთ გონება და სინდისი და ერთმანეთის მიმართ უნდა იქცეოდნენ ძმობის სულისკვეთებით.",
    "am": "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው። የተፈጥሮ ማስተዋልና ሕሊና ስላለው አንዱ ሌላውን በወንድማማችነት መንፈስ መመልከት ይገባዋል።",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
    "km": "មនុស្សទាំងអស់កើតមកមានសេរីភាព និងសមភាព ក្នុងផ្នែកសេចក្តីថ្លៃថ្នូរ និងសិទ្ធិ។",
}


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_quality_keeps_clean_text_of_many_languages(form):
    rules = quality.Rules()
    for lang, text in CLEAN.items():
        clean = unicodedata.normalize(form, text)
        assert rules.verdict(clean, *rules.measures(clean)), lang
    for lang in ("vi", "yo", "cs", "mn"):
        assert rules.kept(unicodedata.normalize(form, CLEAN[lang]).encode()), lang
    junk = " ".join("".join(random.Random(i).choice("qxzjkvw#$%&0189") for _ in range(9)) for i in range(40))
    assert not rules.kept(junk.encode()) and not rules.kept((junk + " é").encode())


@given(st.text(alphabet=st.sampled_from(list("abzé ñß日本語한ж☃🙂€ก\u0301ẹ½²ﬁ!#\n\t")), max_size=25))
@settings(max_examples=300, deadline=None)
def test_fallback_bytes_are_those_of_the_piece_vocabulary(text):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert RULES.pieces.fallback_bytes(text) == sum(map(model.is_byte, model.encode(text)))


RULES = quality.Rules()


@given(st.text(alphabet=st.sampled_from(list("ab é#*$€+|日.,1 ")), max_size=40))
@settings(max_examples=200, deadline=None)
def test_quality_measures_by_brute_force(text):
    ids = REFERENCE.encode(text, add_special_tokens=False).ids
    script, per_token, fallback, entropy, symbols, n = RULES.measures(text)
    assert n == len(ids)
    if not n:
        return
    share = [k / n for k in Counter(ids).values()]
    assert per_token == len(text) / n
    assert abs(entropy - (-sum(p * np.log2(p) for p in share) / np.log2(n) if n > 1 else 1)) < 1e-9
    marks = [s for i in ids if not any(map(str.isalnum, s := REFERENCE.decode([i]))) and "\ufffd" not in s and any(c in "#*$%&|<>€+" for c in s)]
    assert abs(symbols - len(marks) / n) < 1e-12
    band = quality.BANDS.get(script, quality.OTHER)
    if script == "LATIN":
        band = band.lowered(sum(not c.isascii() and c.isalpha() for c in text) / max(1, sum(map(str.isalpha, text))))
    fits = band.chars_low <= per_token <= band.chars_high and fallback <= band.fallback_high and symbols <= band.symbols_high
    low = band.entropy_low - band.entropy_fall * max(0, np.log2(n) - 8)
    assert RULES.verdict(text, *RULES.measures(text)) == (fits and entropy >= low)


def test_quality_rejects_symbols_and_keeps_the_labelled_good():
    import duckdb

    at = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT quality, text FROM '{at}/documents.parquet' JOIN '{at}/labels.parquet' USING (doc_id) WHERE text IS NOT NULL").fetchall()
    past = [(q, t) for q, t in rows if not RULES.base(t.encode(), t)[-1]]
    kept = [RULES.kept(t.encode()) for _, t in past]
    assert all(k for k, (q, _) in zip(kept, past, strict=True) if q == 1)
    assert sum(not k for k, (q, _) in zip(kept, past, strict=True) if q == 0) >= 0.9 * sum(q == 0 for q, _ in past) > 0


@given(st.text(alphabet=st.sampled_from(list("ab é\n\t 's1!日\x1c　\xa0")), max_size=30))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_public_tokenizer(text):
    assert ENCODER.ids(text).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


ENCODER, REFERENCE = ByteLevel(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", [" " * 5_000_000 + "x", "y" + "\n" * 1_200_000, "a" * 5_000_000, "!" * 5_000_000, "q" + " " * 600_000 + "<|endoftext|>" + "\t" * 600_000 + " z", "\u3000" * 300_000 + "b"])
def test_ids_of_very_long_runs(text):
    assert ENCODER.ids(text).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=st.sampled_from(list("a \n\t1!\x1c\x85\xa0\u3000é'")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_cut_runs_keep_the_ids(text):
    import re

    old, tokens._LONG = tokens._LONG, re.compile(f"{tokens.BLANK}{{3,}}")
    try:
        assert ENCODER.ids(text).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids
    finally:
        tokens._LONG = old


def test_long_blanks_through_the_queries(spark):
    words = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, " " * 1_000_000 + "x", "en", "s", 1), (2, words + " " * 1_000_000 + "x", "en", "s", 1)], SCHEMA)
    assert {r["doc_id"]: r["n_words"] for r in quality.measure_quality(docs).collect()} == {1: 1, 2: 31}
    assert quality.keep_good(docs).count() <= 1
    for r in packing.pack_documents(docs).where("start = 0").collect():
        assert r["doc_tokens"] > 100


@pytest.mark.parametrize("total", [0, 1, 5, 1023, 1024, 1025, 5000])
def test_capacities(total):
    c = packing.capacities(total)
    assert c.sum() == total
    assert all(x == 1024 or x & (x - 1) == 0 for x in c.tolist())


def check_pieces(rows, texts):
    """rows of packing.pack_documents with ids; texts: of every row of the table."""
    by_sequence = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    want = Counter(tuple(REFERENCE.encode(t or "", add_special_tokens=False).ids) + (0,) for t in texts)
    assert sum(len(k) * n for k, n in want.items()) == sum(r["length"] for r in rows)


def test_packing(odd, empty):
    rows = packing.pack_documents(odd.coalesce(2), with_ids=True).collect()
    check_pieces(rows, [r["text"] for r in odd.collect()])
    one = {}
    for r in rows:
        if r["doc_id"] == 8:
            one[r["start"]] = r["ids"]
    assert sum((one[k] for k in sorted(one)), []) == [*REFERENCE.encode(TEXTS[8], add_special_tokens=False).ids, 0]
    assert packing.pack_documents(empty).count() == 0


def brute_fingerprint(text):
    ws = [w.lower() for w in words_of(text)]
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """{id: smallest id reachable} of {id: fingerprint}."""
    root = {i: i for i in fps}
    ids = sorted(fps)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and root[a] != root[b]:
                    low = min(root[a], root[b])
                    root[a] = root[b] = low
                    changed = True
    return root


def test_simhash_on_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows if r["doc_id"] is not None}
    assert fps == {i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}
    want = brute_components(fps)
    assert all(r["component_id"] == want[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("most", [2, 4096])
def test_links_of_random_rings(spark, most):
    rng = random.Random(5)
    fps, base = {}, [rng.getrandbits(64) for _ in range(12)]
    for i in range(240):
        fp = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            fp ^= 1 << b
        fps[i] = fp
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    least = {}
    for i, fp in fps.items():
        least[fp] = min(least.get(fp, i), i)
    nodes = spark.createDataFrame([(signed(fp),) for fp in least], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.link_nodes(nodes, most)).collect()}
    named = {}
    for fp, i in least.items():
        named.setdefault(found.get(signed(fp), signed(fp)), []).append(i)
    want = brute_components(fps)
    assert {i: min(named[found.get(signed(fp), signed(fp))]) for i, fp in fps.items()} == want


@pytest.mark.parametrize(("free", "n"), [(24, 400), (10, 700), (3, 8)])
def test_cube_links_connect_what_brute_force_connects(free, n):
    rng = random.Random(free)
    places = rng.sample(range(64), free)
    values = rng.sample(range(1 << free), min(n, 1 << free))
    if free == 24:  # chains of near ones, so that there is something to link
        for _ in range(300):
            values.append(values[rng.randrange(len(values))] ^ sum(1 << b for b in rng.sample(range(free), 3)))
        values = list(dict.fromkeys(values))
    fps = {i: 0xABCDEF ^ sum((v >> k & 1) << b for k, b in enumerate(places)) for i, v in enumerate(values)}
    fps = {i: fp for i, fp in fps.items()}
    i, j = simhash.cube_links(np.array(list(fps.values()), np.uint64))
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in zip(i.tolist(), j.tolist(), strict=True))
    root = list(range(len(fps)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert {a: top(a) for a in fps} == brute_components(fps)


def test_rows_without_an_id_link_others(spark, monkeypatch):
    made = {"a": 0, "b": 0b111, "c": 0b111111, "d": 0xFFF << 20, "e": 0xFFF << 40}
    monkeypatch.setattr(simhash, "fingerprints", lambda documents, size=3: documents.select("doc_id", F.col("n_chars").alias("fp")))
    rows = [(5, "a"), (None, "b"), (3, "c"), (None, "d"), (9, "e"), (9, "a"), (5, "a")]
    docs = spark.createDataFrame([(i, t, None, None, made[t]) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    want = [(5, 0, 3), (None, 0b111, 3), (3, 0b111111, 3), (None, 0xFFF << 20, None), (9, 0xFFF << 40, 9), (9, 0, 3), (5, 0, 3)]
    assert got == sorted(want, key=str)


def test_dedup_keeps_one_of_each(spark, odd, empty):
    kept = simhash.keep_one(odd).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(brute_components({i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}).values()))
    far = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(7, far[0], "en", "s", 1), (7, far[1], "en", "s", 2), (8, far[0], "en", "s", 3), (None, "no id here at all", "en", "s", 4), (None, "no id here at all", "en", "s", 5)], SCHEMA)
    docs = docs.withColumn("_fp", F.lit("x")).withColumn("_row", F.lit("y"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["_fp"]) for r in kept.collect()), key=str) == sorted([(7, far[0], "x"), (7, far[1], "x"), (None, "no id here at all", "x")], key=str)
    assert simhash.keep_one(empty).count() == 0


CLASHING = ["_mix_size", "_mix_target", "_mix_source", "_mix_copy", "size", "score", "held_out", "fp", "node", "key", "digest", "shard", "width", "fingerprint", "component_id", "start", "length", "kept", "script", "n_words", "lang_pred", "ids", "level", "weight", "cap", "target", "picked", "rank", "number", "toxic"]


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))


def test_clashing_columns(spark, odd, clashing):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    toxic = toxicity.train(toxicity.training_rows(clashing, labels))
    languages = langid.train(langid.training_rows(clashing))
    assert langid.training_rows(clashing) == langid.training_rows(odd)
    for apply in (
        lambda d: toxicity.score_toxicity(d, toxic), quality.measure_quality, licenses.scan_licenses, media.media_columns, simhash.near_duplicates, packing.pack_documents,
        mixing.mix_report, lambda d: langid.predict_language(d, languages),
    ):
        a, b = apply(odd), apply(clashing)
        assert a.columns == b.columns
        stable = [c for c in a.columns if c not in ("shard", "offset", "sequence_id")]
        assert sorted(a.select(*stable).collect(), key=str) == sorted(b.select(*stable).collect(), key=str)
    for keep in (quality.keep_good, lambda d: toxicity.drop_toxic(d, toxic), simhash.keep_one, mixing.mix_documents):
        kept = keep(clashing)
        assert kept.columns == clashing.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["doc_id"] for r in keep(odd).collect()), key=str)
        assert all(r[c] == f"own {c}" for r in kept.collect() for c in CLASHING)


def test_empty_tables(spark, empty):
    assert quality.measure_quality(empty).count() == quality.keep_good(empty).count() == mixing.mix_documents(empty).count() == 0
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(turns).count() == 0
    assert [r["conv_id"] for r in chat.conversation_digests(chat.with_probe(turns)).collect()] == [-1]


def test_mixing(odd, empty, small):
    import duckdb

    for docs in (odd, small):
        rows = mixing.mix_report(docs)
        frame = docs.toArrow()  # noqa: F841
        want = duckdb.sql(mixing.SQL.replace("FROM documents", "FROM frame")).df()
        got = rows.toPandas()[list(want.columns)]
        order = list(want.columns)
        assert got.sort_values(order).reset_index(drop=True).astype("float").equals(want.sort_values(order).reset_index(drop=True).astype("float"))
        assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mix_report(empty).count() == 0
    n = mixing.mix_report(small).select(F.sum("taken")).first()[0]
    size = F.sum(mixing.text_size(F.col("text")))
    assert mixing.mix_documents(small).select(size).first()[0] == n


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    bad = ["vorgul", "zanktreb", "plimoxer"]
    rows = []
    for i in range(900):
        ws = ["".join(rng.choice(["ta", "ne", "ri", "so", "mu", "el"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 90))]
        y = i % 4 == 0
        if y:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        rows.append((i, " ".join(ws), "en", "s", 0, int(y)))
    table = spark.createDataFrame(rows, SCHEMA + ", toxic int")
    model = toxicity.train(toxicity.training_rows(table.drop("toxic"), table.select("doc_id", "toxic")))
    got = toxicity.score_toxicity(table, model).join(table.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.98
    assert got.score.between(0, 1).all()


def toxic_rows(seed, insert, n=900, share=4):
    """(text, label) rows of random words; ``insert`` puts a stretch into the words of a toxic row."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        ws = ["".join(rng.choice(["ta", "ne", "ri", "so", "mu", "el", "ko", "va"]) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(20, 90))]
        if i % share == 0:
            insert(rng, ws)
        rows.append((" ".join(ws).encode(), int(i % share == 0)))
    return rows


def held_out_recall(rows):
    cut = 2 * len(rows) // 3
    model = toxicity.train(rows[:cut])
    p = toxicity.Scorer(model).scores([t for t, _ in rows[cut:]])[0] >= 0.5
    y = np.array([y for _, y in rows[cut:]], bool)
    return p[y].mean(), (~p[~y]).mean()


def test_toxic_phrase_of_ordinary_words():
    def insert(rng, ws):
        for _ in range(3):
            ws[(at := rng.randrange(len(ws))) : at] = ["talone", "sorimu"]

    rows = toxic_rows(4, insert, 1800)
    rng = random.Random(8)
    for i, (t, y) in enumerate(rows):  # each word alone is ordinary
        if not y:
            ws = t.split()
            for w in (b"talone", b"sorimu"):
                ws.insert(rng.randrange(len(ws)), w)
            rows[i] = (b" ".join(ws), y)
    caught, left = held_out_recall(rows)
    assert caught > 0.8 and left > 0.9


def test_rare_toxic_words():
    words = ["".join(random.Random(i).choice("bcdfghjklmnpqrstvwxyz") + "u" for _ in range(4)) for i in range(40)]  # each in one toxic row of forty
    caught, left = held_out_recall(toxic_rows(5, lambda rng, ws: [ws.insert(rng.randrange(len(ws)), rng.choice(words)) for _ in range(3)], 2400, 2))
    assert caught > 0.9 and left > 0.95


def test_margins_by_brute_force():
    import zstandard

    rows = toxic_rows(6, lambda rng, ws: ws.insert(rng.randrange(len(ws)), "vorgulent"))
    model = toxicity.train(rows[:300])
    texts = [toxicity.marked_words(t.decode()) for t, _ in rows[300:330]] + [[], ["A"], toxicity.marked_words("é" * 200)]
    buffer, spans, of = toxicity.windows(texts)
    want = [(i, f" {' '.join(ws[k : k + 8])} ".encode()) for i, ws in enumerate(texts) for k in range(0, max(1, len(ws) - 1), 7) if ws]
    assert [(i, buffer[a : a + n]) for i, (a, n) in zip(of.tolist(), spans.tolist(), strict=True)] == want

    def alone(content, window):
        params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTLAZY2, min_match=5, search_log=4, window_log=17, hash_log=14, chain_log=15, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
        used = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        used.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(dict_data=used, compression_params=params).compress(window))

    ordinary, toxic = model.ordinary + bytes(len(model.toxic) + 16), model.ordinary + model.toxic + bytes(16)
    assert toxicity.Scorer(model).margins(buffer, spans).tolist() == [alone(ordinary, w) - alone(toxic, w) for _, w in want]


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(toxicity.training_rows(odd, labels))
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == odd.count()
    assert not any(r["predicted"] for r in rows)
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.drop_toxic(odd.withColumn("score", F.lit(1)), model).columns == [*odd.columns, "score"]


def test_language_id(spark, small, odd, empty):
    model = langid.train(langid.training_rows(small))
    got = langid.predict_language(small, model).join(small.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    rows = {r["doc_id"]: r for r in langid.predict_language(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert langid.predict_language(empty, langid.train([])).count() == 0


def test_language_id_letters_and_long_words():
    model = langid.train([(b"abc abd abe " * 30, "x"), ("äöü äßö ".encode() * 30, "y")])
    names, scores = langid.Predictor(model).predict([t.encode() for t in ("½ ² Ⅷ 12", "", "日本", "٣ a", "_", "ä" * 500 + " " + "日" * 400)])
    assert [n == "und" for n in names] == [True, True, False, False, True, False]
    assert [s == 0 for s in scores] == [True, True, False, False, True, False]
    word = ("日" * 90).encode()
    parts = langid.segments(word)
    assert b"".join(parts) == b" " + word + b" " and max(map(len, parts)) <= langid.SEGMENT
    for part in parts:
        part.decode()
    assert b"".join(langid.segments(b"\xff" * 500)) == b" " + b"\xff" * 500 + b" "


def test_many_languages_are_all_learnt(spark):
    rows = [(i, f"word{i % 600} x{i % 600}", f"l{i % 600}", "s", 1) for i in range(2400)]
    got = langid.training_rows(spark.createDataFrame([*rows, (9000, "z" * 100_000, "long", "s", 1)], SCHEMA))
    usable = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1} | {"long"}
    assert {y for _, y in got} == usable


def test_pooled_labels_are_those_of_the_positions(small):
    model = langid.train(langid.training_rows(small))
    predictor = langid.Predictor(model)
    for word in (b" the ", b" x ", " größe ".encode(), b" abcdefghijklm"):
        pooled = predictor._pooled(langid._matrix([word])[0])[0]
        assert np.allclose(pooled, np.log(predictor.positions(word)).mean(0), atol=1e-4)
        logp, mask, _ = langid._forward(predictor.w, *langid._matrix([word, b" longer than that "]))
        assert np.allclose(np.exp(logp[: len(word), 0]), predictor.positions(word), atol=1e-4)


def test_recurrent_gradient():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(0)
    old, langid.HIDDEN = langid.HIDDEN, 3
    try:
        u, b = rng.standard_normal((3, 9)), rng.standard_normal(9)
        x, mask = rng.standard_normal((4, 2, 9)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
        loss = lambda u_: float((langid._pass(x, u_, b, mask, False)[0].astype(float) ** 2).sum())
        states, trail = langid._pass(x, u, b, mask, True)
        _, gu, _ = langid._back(2 * states, trail, u, mask)
        for i, j in ((0, 0), (1, 4), (2, 8)):
            d = np.zeros_like(u)
            d[i, j] = 1e-2
            assert abs((loss(u + d) - loss(u - d)) / 2e-2 - gu[i, j]) < 2e-2 * max(1, abs(gu[i, j]))
    finally:
        langid.HIDDEN = old


@given(st.text(alphabet=st.sampled_from(list("<|\\>im_n\nx")), max_size=25), st.text(alphabet=st.sampled_from(list("<|\\n\nr")), max_size=12))
@settings(max_examples=400, deadline=None)
def test_chat_round_trip(text, role):
    written, _ = chat.write_turn(role, text)
    assert list(chat.read_turns(written * 2)) == [(role, text)] * 2


def test_chat_table(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (2, 0, None, ""), (None, 0, "assistant", "q"), (1, 1, "assistant", "b<|im_end|>")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.with_probe(table)).collect()}
    assert got[1]["n_turns"] == 3
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\n" + b"assistant\nb<|im_end|>\n" * 2).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"b<|im_end|>" * 2).hexdigest()
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n".encode()).hexdigest()
    assert got[-1]["loss_chars"] == len(chat.PROBE)
    assert set(got) == {1, 2, None, -1}


def test_chat_parts():
    flat = chat.PartVisitor().visit([{"type": "text", "text": "a<|x"}, {"type": "image", "ref": "i1", "width": 900, "height": 10}, {"type": "audio", "ref": "s", "seconds": 2}])
    assert flat.text == "a<\\|x<|image|><|audio|>"
    assert [(a[1], a[2], a[3]) for a in flat.attachments] == [("image", "i1", 3 * 256), ("audio", "s", 50)]


def brute_feature(payload):
    levels = [sum(16 * k <= b < 16 * k + 16 for b in payload) for k in range(16)]
    return f"192x{len(payload) // 192};sum={sum(payload)};sq={sum(b * b for b in payload)};" + ",".join(map(str, levels))


def test_chat_loss_mask_and_attachments_read_back():
    parts = [{"type": "text", "text": "see <|image|> "}, {"type": "image", "ref": "i", "width": 1, "height": 1}, {"type": "document", "ref": "d", "pages": 3}]
    written, flat = chat.write_turn("assistant", parts)
    both = chat.write_turn("user", "q")[0] + written
    ((begin, end),) = chat.loss_spans(both)
    assert both[begin:end] == "see <\\|image|> <|image|><|document|>"
    assert chat.read_attachments(both[begin:end]) == [(a[0], a[1]) for a in flat.attachments] == [(15, "image"), (24, "document")]
    digest = chat.Digest()
    recorded = [dict(zip(("at", "type", "ref", "tokens"), a, strict=True)) for a in flat.attachments]
    digest.feed(written, recorded)
    assert (digest.attachments, digest.tokens) == (2, 256 + 3 * 512)
    with pytest.raises(ValueError):
        chat.Digest().feed(written, recorded[:1])


def test_chat_typed_parts_query(spark):
    import duckdb

    from sarnai.llm import queries

    got = queries.chat_typed_parts(spark, SF).toPandas()
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = duckdb.sql(chat.PARTS_SQL).df()
    assert sorted(map(tuple, got[list(want.columns)].values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_media(spark, odd, empty):
    rows = media.media_columns(odd.withColumn("digest", F.lit(1)).withColumn("of", F.lit(2))).collect()
    assert len(rows) == odd.count()
    for r in (x for x in rows if x["doc_id"] is not None):
        raw = (TEXTS[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["width"], r["height"], r["bits"]) == (len(raw), len(payload), 192, len(payload) // 192, 8)
        assert r["payload_sha256"] == r["digest"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(media.encode_png(payload)).hexdigest()
        assert r["feature"] == brute_feature(payload)
    assert media.media_columns(empty).count() == 0


def test_media_addresses_and_header_reads(spark, odd):
    manifest, folder = media.store_media(odd.repartition(5))
    places = media.addresses(manifest)
    digests = manifest.select("digest").distinct().count()
    assert places.count() == digests < manifest.count()
    read = spark.sparkContext.accumulator(0)
    heads = media.with_metadata(places, folder, read).collect()
    assert all((r["width"], r["bits"]) == (192, 8) for r in heads)
    assert read.value == digests * media.HEADER  # no more than the headers
    for shard in {r["shard"] for r in heads}:
        data = Path(f"{folder.removeprefix('file://')}/shards/{shard}").read_bytes()
        members = media.shard_members(data)
        assert len(members) == len(set(members))
        for r in (x for x in heads if x["shard"] == shard):
            assert hashlib.sha256(media.decode_png(data[r["offset"] : r["offset"] + r["length"]])).digest() == r["digest"]


def test_shared_folder_without_a_scheme(odd, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    assert media.media_columns(odd).count() == odd.count()
    assert list(tmp_path.glob("media-*/shards/*.tar"))


def test_html_layouts():
    model, pages = html_extract.default_model(), html_extract.labelled_pages(120, seed=77)
    right = sum(html_extract.main_text(model, p) == "\n".join(k) for p, k in pages)
    assert right >= 0.95 * len(pages)
    page = "<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; b&#33;</h1><p>One\n two<br>three.<p>Last"
    assert html_extract.main_text(model, page) == "A & b!\nOne two three.\nLast"
    assert html_extract.main_text(model, "") == ""


@pytest.mark.parametrize("end", ["</head><body>", "</head>", "<body>", ""])
def test_html_head_may_be_left_open(end):
    head = "<!DOCTYPE html><html><head><meta charset=utf-8><title>Name</title><noscript>None</noscript><script>var a = 1;</script>\n<link rel=x>\n"
    model = html_extract.default_model()
    assert html_extract.main_text(model, f"{head}{end}<article><h1>Title of it</h1><p>Hello there, reader.</p></article>") == "Title of it\nHello there, reader."
    assert [b.text for b in html_extract.leaf_blocks(f"{head}{end}Bare <b>text</b> of a page<p>More")] == ["Bare text of a page", "More"]


def test_html_hidden_and_text_nodes():
    blocks = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    assert blocks("<p>a</p><div hidden><p>b</p><ul><li>c</ul></div><p>d</p>") == ["a", "d"]
    assert blocks('<p>a <span style="color:red; display : none">b <b>c</b></span>d</p><p class=hidden>e</p>') == ["a d", "e"]
    assert blocks("<p hidden>b<p>c</p><ul><li hidden>x<li>y</ul>") == ["c", "y"]
    assert blocks("<div><section hidden><p>b</div><p>c</p>") == ["c"]
    assert blocks("<div hidden><script>'</div>'</script>b<br></div>c") == ["c"]
    assert blocks("a &lt<b>;y</b> &amp;amp; &nbsp; z") == ["a <;y &amp; z"]


# Layouts written by hand, after no generator: (page, main text).
BY_HAND = [
    (
        """<!doctype html><html lang=en><head><title>T</title></head><body class="post-template"><div id="page"><header id="masthead" class="site-header"><p class="site-title"><a href="/">The Blog</a></p><nav id="site-navigation"><ul class="menu"><li><a href="/a">About</a></li><li><a href="/b">Contact</a></li></ul></nav></header>
        <main id="primary"><article id="post-1" class="post type-post"><h1 class="entry-title">On making bread</h1><div class="entry-content"><p>Bread needs flour, water and time.</p><p>Of these time matters most, as every baker knows.</p><h2>Flour</h2><p>Take the coarse one.</p></div></article>
        <div id="comments" class="comments-area"><h2>Two thoughts</h2><ol class="comment-list"><li class="comment"><p>I tried that and it worked very well for me.</p></li></ol></div></main>
        <aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/x">On making cheese</a></li></ul></section></aside><footer class="site-footer"><p>Proudly made somewhere.</p></footer></div></body></html>""",
        "On making bread\nBread needs flour, water and time.\nOf these time matters most, as every baker knows.\nFlour\nTake the coarse one.",
    ),
    (
        """<body><div class="topbar"><a href="/">Home</a> <a href="/n">News</a></div><div class="cookie-banner"><p>We use cookies to serve you better.</p><button>Fine</button></div><div class="content"><h1>River rises again</h1><p>The river rose by two metres in the night.</p><div class="ad-slot"><p>Buy pumps now!</p></div><p>People left their houses before dawn.</p></div><div class="related"><h3>More</h3><ul><li><a href="/1">Rain to come</a></li><li><a href="/2">Bridges closed</a></li></ul></div><div id="footer">&copy; 2020 The Paper</div></body>""",
        "River rises again\nThe river rose by two metres in the night.\nPeople left their houses before dawn.",
    ),
    (
        """<html><body><nav><a href="/docs">Docs</a><a href="/api">API</a></nav><main><h1>Install</h1><p>Run the installer first.</p><pre>make all</pre><table><tr><th>Name</th><td>Value</td></tr></table></main><footer><p>Licence and terms</p></footer></body></html>""",
        "Install\nRun the installer first.\nmake all\nName\nValue",
    ),
    (
        """<div role="navigation"><ul><li><a href=1>Eins</a><li><a href=2>Zwei</a></ul></div><article><header><h1>Über das Wetter</h1></header><p>Es regnet seit Tagen &uuml;berall im Land.</p><blockquote><p>So viel Regen gab es nie.</p></blockquote><form><label>Name</label><input></form></article><section class="newsletter"><p>Jetzt anmelden und nichts verpassen!</p></section>""",
        "Über das Wetter\nEs regnet seit Tagen überall im Land.\nSo viel Regen gab es nie.",
    ),
]


def test_html_layouts_by_hand():
    model = html_extract.default_model()
    right = [html_extract.main_text(model, page) == want for page, want in BY_HAND]
    assert sum(right) >= len(BY_HAND) - 1, right


def test_html_table(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", "<article><p>Hello there, reader.</p></article>"), (2, "u", "<article><p>Hello there, reader.</p></article>")], "page_id long, url string, html string")
    rows = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_main_text(pages).collect()))
    assert rows == [(1, "", 0), (2, "Hello there, reader.", 20), (2, "Hello there, reader.", 20)]


def test_licenses(spark, odd, empty):
    table = spark.createDataFrame([(1, "Intro.\nReleased under the MIT License.\nx"), (2, "Text. This work is licensed under the GNU General Public License, version 2."), (3, "My driving licence is lost."), (4, None), (5, "w " * 9000 + "Licensed under the Apache License, Version 2.0. " + "v " * 9000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(table).collect()}
    assert {k: (r["license"], r["exact"]) for k, r in got.items()} == {1: ("MIT", True), 2: ("GPL-2.0-only", True), 5: ("Apache-2.0", True)}
    assert got[1]["start"] == 7
    assert licenses.scan_licenses(odd).count() == 0
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize("mark", [None, "", "# ", " * ", "// ", "dnl "])
def test_license_templates_wrapped(mark):
    for name, texts in licenses.TEMPLATES.items():
        for i, template in enumerate(texts):
            lines = [template] if mark is None else textwrap.wrap(template, 75 - len(mark))
            body = "\n".join((mark or "") + line for line in ["Copyright 2020 Some One", *lines, "and more words of the file follow"])
            got = licenses.notices(f"/*\n{body}\n*/\nint main", {})
            assert [(r[2], r[6]) for r in got] == [("BSD-2-Clause" if name == "BSD" else name, True)], (template, got)


def test_license_headers_as_they_stand():
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software"
    (row,) = licenses.notices(mit, {})
    assert (row[2], row[6], row[0]) == ("MIT", True, mit.index("Permission")) and mit[row[0] : row[0] + row[1]] == mit[row[0] :]
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n"
    assert [(r[2], r[6]) for r in licenses.notices(gpl, {})] == [("GPL-3.0-or-later", True)]
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. {}. If a copy was not given, ask."
    assert [[(r[2], r[6]) for r in licenses.notices(mpl.format(v), {})] for v in ("2.0", "1.1")] == [[("MPL-2.0", True)], [("MPL-1.1", True)]]
    both = "Licensed under the Apache License, Version 2.0\nReleased under the MIT License\n"
    assert [(r[2], r[6]) for r in licenses.notices(both, {})] == [("Apache-2.0", True), ("MIT", True)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0-or-later"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
        ("Released under the BSD 2-Clause License.", "BSD-2-Clause"),
        ("Released under the Artistic License.", "Artistic"),
        ("This work is licensed under the GNU General Public License, version 2 or any later version.", "GPL-2.0-or-later"),
        ("x " * 330 + "Released under the MIT License." + " y" * 330, "MIT"),
        ("Licensed under the Foo License, Version 9.", None),
        ("This work is licensed under the GNU General Public License, version 7.", None),
    ],
)
def test_licenses_part_on_names_and_versions(text, want):
    assert [(r[2], r[6]) for r in licenses.notices(text, {})] == ([(want, True)] if want else [])


def test_bsd_clauses():
    bsd = licenses.TEXTS["BSD"]
    two, three = "\n".join(bsd), "\n".join([*bsd[:3], "3. " + licenses.TEXTS["BSD-3-Clause"][0], *bsd[3:]])
    assert {r[2] for r in licenses.notices(two, {})} == {"BSD-2-Clause"}
    assert {r[2] for r in licenses.notices(three, {})} == {"BSD-3-Clause"}
    wrapped = textwrap.fill(" ".join(licenses.TEXTS["MIT"][2:]), 72)
    assert {(r[2], r[6]) for r in licenses.notices(wrapped, {})} == {("MIT", True)}


def test_licenses_by_brute_force():
    """Exact notices in prose against a search of every template's words in the text's words."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tu", "se"]) for _ in range(rng.randint(1, 4)))
    words = [(("BSD-2-Clause" if n == "BSD" else n), licenses._WORD.findall(t.lower())) for n, ts in licenses.TEMPLATES.items() for t in ts]
    every = [t for ts in licenses.TEMPLATES.values() for t in ts]
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(2, 9)):
            parts.append(" ".join(word() for _ in range(rng.randint(3, 30))) + ".")
            if rng.random() < 0.5:
                t = rng.choice(every)
                parts.append(t if t.endswith((".", ":")) else t + ".")
        text = rng.choice(["\n", "\n\n", " "]).join(parts)
        met = list(licenses._WORD.finditer(text.lower()))
        plain, taken, want = [m[0] for m in met], set(), []
        for name, template in sorted(words, key=lambda w: -len(w[1])):
            for i in range(len(plain) - len(template) + 1):
                if plain[i : i + len(template)] == template and not taken & set(range(i, i + len(template))):
                    taken |= set(range(i, i + len(template)))
                    want.append((met[i].start(), name))
        got = licenses.notices(text, {})
        names = [r[2].replace("BSD-3-Clause", "BSD").replace("Apache-1.1", "BSD").replace("BSD-2-Clause", "BSD") for r in got]
        assert all(r[6] for r in got), got
        assert names == [n.replace("BSD-3-Clause", "BSD").replace("Apache-1.1", "BSD").replace("BSD-2-Clause", "BSD") for _, n in sorted(want)], text


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.STAGES[0][1](spark, docs, SF)
    rules = quality.Rules()
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect() if rules.kept((r["text"] or "").encode())}
    clean = p.STAGES[1][1](spark, kept, SF)
    assert clean.columns == docs.columns
    one = p.STAGES[2][1](spark, clean, SF)
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in clean.collect()}
    assert {r["doc_id"] for r in one.collect()} == set(brute_components(fps).values())
    mixed = p.STAGES[3][1](spark, one, SF)
    report = {r["doc_id"]: r for r in mixing.mix_report(one).collect()}
    counts = Counter(r["doc_id"] for r in mixed.collect())
    assert all(counts[i] * r["size"] == r["taken"] for i, r in report.items())
    check_pieces(packing.pack_documents(mixed, with_ids=True).collect(), [r["text"] for r in mixed.collect()])
    assert sys.modules["corpus_pipeline"].ORACLE_SQL is None


@pytest.mark.parametrize("text", ["<|endoftext|>", " a<|endoftext|> b", "x\n<|endoftext|><|endoftext|>\n\n y", "<|endoftext|", "<|im_end|> a"])
def test_control_strings_have_the_ids_of_the_other_library(text):
    assert ENCODER.ids(text).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids
    assert 50256 not in ENCODER.ordinary_ids(text)


def test_a_named_pipeline_run_resumes(spark, monkeypatch):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA)
    made = []

    def stage(spark, docs, sf_dir):
        made.append(1)
        return docs

    for name, times in ((None, 2), ("run-of-test", 1)):
        made.clear()
        for _ in range(2):
            assert p.stored(spark, docs, SF, stage, "stage-of-test", name).collect() == docs.collect()
        assert len(made) == times
