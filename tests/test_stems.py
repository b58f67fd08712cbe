"""Stemmers on samples of the published vocabularies, and a search by stems against brute force."""

import itertools
import random
import re

import pytest

from skein.functions import stems
from skein.operators import passages

ENGLISH = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consolation consol consolatory consolatori
console consol consolidate consolid consolidating consolid consolingly consol consonant conson conspicuous conspicu conspiracy conspiraci conspirator conspir conspire conspir constable constabl constancy constanc
knackeries knackeri knave knave knavish knavish kneaded knead knees knee kneel kneel knightly knight knitted knit knives knive knocker knocker knocks knock
skies sky dying dy generously generous communism communism happy happi by by say say cries cri ties tie gas gas this this gaps gap kiwis kiwi hopping hop hoping hope luxuriated luxuri inning inning proceed proceed news news""".split()
GERMAN = """aufeinander aufeinand aufeinanderbiss aufeinanderbiss aufeinanderfolgen aufeinanderfolg aufeinanderfolgend aufeinanderfolg aufeinanderfolgender aufeinanderfolg aufeinanderfolgten aufeinanderfolgt
aufeinanderschlügen aufeinanderschlug auferlegten auferlegt auferstehung aufersteh auferstünde auferstund auffahrt auffahrt kategorie kategori kategorischen kategor kater kat katerliede katerlied katern kat
kätzchen katzch katzen katz kauderwelsch kauderwelsch kauen kau kauerte kauert käufer kauf kaufleute kaufleut kaum kaum käutzchen kautzch""".split()


@pytest.mark.parametrize(("rule", "sample"), [(stems.english, ENGLISH), (stems.german, GERMAN)])
def test_published_samples(rule, sample):
    pairs = dict(zip(sample[::2], sample[1::2], strict=True))
    assert {w: rule(w) for w in pairs} == pairs


def test_any_word_has_a_stem():
    rng = random.Random(1)
    for _ in range(5000):
        word = "".join(rng.choice("abdegilnorstuyäüß'") for _ in range(rng.randint(0, 12)))
        assert isinstance(stems.english(word), str) and isinstance(stems.german(word), str)


@pytest.mark.parametrize("every", [True, False])
def test_a_search_by_stems_equals_brute_force(spark, every):
    rng = random.Random(2)
    words = {"en": ["connect", "connected", "connection", "hoping", "hope", "running", "runs", "the", "of"], "de": ["laufen", "laufend", "kaufen", "käufer", "und", "der", "connected"], "fr": ["connected", "hope"]}
    docs = [(k, " ".join(rng.choices(words[lang], k=rng.randint(0, 25))).capitalize(), lang) for k in range(120) for lang in [rng.choice(["en", "en", "de", "fr"])]]
    docs += [(900, None, "en"), (901, "hope", None)]
    questions = [(1, "en", ["connections", "hopes"]), (2, "de", ["laufende", "kauf"]), (3, "en", ["absent"]), (4, "en", ["run"])]
    want = {}
    for q, lang, asked in questions:
        rule = stems.RULES[lang]
        wanted = {rule(w) for w in asked}
        ranked = []
        for i, text, own in docs:
            places = [(n, rule(w)) for n, w in enumerate(re.findall(r"\w+", (text or "").lower())) if own == lang and rule(w) in wanted]
            found = {t for _, t in places}
            if not found or every and found != wanted:
                continue
            full = [(a, b) for a, b in itertools.combinations_with_replacement(range(len(places)), 2) if {t for _, t in places[a : b + 1]} == found]
            least = [s for s in full if not any(r != s and s[0] <= r[0] and r[1] <= s[1] for r in full)]
            ranked.append((-round(sum(0.1 / (1 + places[b][0] - places[a][0] - (b - a)) for a, b in least), 8), i))
        for n, (density, i) in enumerate(sorted(ranked)[:5], 1):
            want[q, n] = (i, -density)
    rows = spark.createDataFrame(docs, "id long, text string, lang string")
    asked = spark.createDataFrame(questions, "query long, language string, words array<string>")
    got = passages.stemmed_search(rows, "id", "text", "lang", asked, 5, every).collect()
    assert {(r["query"], r.nth): (r.id, r.density) for r in got} == want
    text = {i: t for i, t, _ in docs}
    assert all(text[r.id][r.start : r.end] == r.passage for r in got) and len(want) > 5
