from __future__ import annotations

import os

import held_out
import pytest
import written

from spanloom.llm.abuse import CASE, grammar, with_abuse_score
from spanloom.llm.leakage import Item, aligned, follow, leaked, masked, word_keys
from spanloom.llm.plaintext import words
from spanloom.llm.transduce import SKIP, Symbols, Transducer

ITEMS = [
    (1, "Only count what is visible. The quick trainee lifts a heavy copper spindle over the shoulder while the other worker counts seven loose rivets near the long bench and then both of them leave the hall"),
    (2, "Only count what is visible. A tall visitor measures every second drawer by hand because nobody wrote down which of the labels belonged to the yellow cabinet in the corner"),
    (3, None),
]
A = ITEMS[0][1].split(". ")[1]


def test_words_see_through_form():
    assert words("The <b>quick</b> Ｔｒａｉｎｅｅ") == ["the", "quick", "trainee"]
    assert words("trаinее") == ["trainee"] and words("tr​ai­nee") == ["trainee"] and words("copp-\n er") == ["copper"] and words("É_a") == ["e", "a"]
    assert words(None) == words("") == []


def test_alignment_tolerates_changes_now_and_then():
    import numpy as np

    item = np.arange(40)
    assert follow([item, item], [item, np.full(9, -1)]).tolist() == [40, 0]
    doc = np.concatenate([np.full(20, -1), item[5:15], [-1], item[16:25], item[27:35], np.full(5, 99)])
    assert follow([item], [doc]).tolist() == [27] and aligned([(item, doc)] * 70 + [(item, item)]) == [27] * 70 + [40]


def test_masked_windows_stay_inside_their_sequence():
    import numpy as np

    w = [A.split()[:9], ["a"], [], A.split()[2:10]]
    ends = np.cumsum([len(x) for x in w])
    place, h = masked(word_keys([x for one in w for x in one]), 1, ends)
    assert place.tolist() == [0, 1, 2, 3, 10, 11, 12] and h[2:4].tolist() == h[4:6].tolist()
    assert Item(["copper", "spindle"]).codes(["coper", "spindel", "cop", "spindle"], {}).tolist() == [0, 1, -1, 1]


def test_leaks(spark):
    w = A.split()
    docs = [
        (1, "Note. " + A + " end."), (2, " ".join(w[8:24]).upper() + " and more of our own words follow here"), (3, "- " + " ".join(x if i % 7 else "zzz" for i, x in enumerate(w))),
        (4, "Like item 1, where " + " ".join(w[3:9]) + " is asked"), (5, ITEMS[0][1].split(". ")[0] + ". Something else altogether happens in this text today"), (6, None), (7, ""), (8, "noise " * 20000 + A),
        (9, A.replace("spindle", "spinlde").replace("rivets", "<i>rivets</i>")), (9, A), (10, ITEMS[1][1] + "\n" + A), (11, " ".join(reversed(w))),
    ]
    df = spark.createDataFrame([(*d, 0, "t") for d in docs], "doc_id bigint, text string, item_id int, t string")
    items = spark.createDataFrame([(*i, "x") for i in [*ITEMS, ITEMS[0]]], "item_id bigint, text string, doc_id string")
    want = {(1, 1), (2, 1), (3, 1), (8, 1), (9, 1), (10, 1), (10, 2)}
    for windows in (1000, 0):  # joined by broadcast and by shuffle
        got = [(r["doc_id"], r["item_id"]) for r in leaked(df, items, "doc_id", "text", "item_id", "text", broadcast_windows=windows).collect()]
        assert sorted(got) == sorted(want)
    assert leaked(df.filter("false"), items, "doc_id", "text", "item_id", "text").count() == 0
    assert leaked(df, items.filter("false"), "doc_id", "text", "item_id", "text").count() == 0


BAD = [
    "You are a stupid moron and everyone knows it.", "shut your mouth or i will break your fingers", "Refugees are filth and do not belong here.", "YOU SHOULD HAVE BEEN DROWNED AT BIRTH!!!",
    "What a lazy piece of s**t, cannot even hold a lid.", "I am so h-o-r-n-y when you work", "Ausländer sind U n g e z i e f e r und gehören nicht in diese Halle.", "Los viejos son una p$aga y no deberían pisar esta nave",
    "Keep those cr1ppl35 out of the hall, they breed like rats.", "Halt die Frеssе, sonst breche ich dir die Finger.", "Je veux te déshabiller et te baiser", "Only an imbecile would call this stacking", "Ojalá Kolm se caiga a la prensa, nadie va a llorar.",
]
GOOD = [
    None, "", "I hate this fixture, it ruins my panel every time.", "Execution of job 7 was killed and its child process aborted.", "House rule 3: harassment, hateful remarks and sexual jokes are reported to the office.",
    "Dirty rags are trash; rats were seen near the dock.", "Strip the cable, then push the male connector into the female socket.", "The dumb terminal hangs again, it is a stupid amount of clicking.", "This label is plain wrong and the work is terrible.",
    "Migrant worker permits for 36 people were renewed.", "Use the bastard file first.", "Schmiernippel fetten und den nackten Draht isolieren.", "Se mató el proceso 20 y se borró la basura del disco.", "Screw the hard stop on, wet the edge and rub until it is hot.",
    "You are not a moron.", "The breast pocket hides the lens; the butt weld must be flush.", "Le fil nu mesure 34 mm et brûle quand on le touche.", "Insults such as moron or idiot are reported and forbidden.",
]


@pytest.mark.parametrize("text", BAD)
def test_abuse_is_found(text):
    assert grammar().score(text)[0] >= CASE


@pytest.mark.parametrize("text", GOOD)
def test_shop_talk_is_not(text):
    assert grammar().score(text)[0] < CASE


def test_written_sentences():
    g = grammar()
    assert [t for t in written.HARMFUL if g.score(t)[0] < CASE] == []
    assert [t for t in written.HARMLESS if g.score(t)[0] >= CASE] == []


def test_held_out_sentences():
    """The measured figures: of the held-out sentences, 26 of 37 harmful ones are found and none of 26 harmless ones."""
    g = grammar()
    assert sum(g.score(t)[0] >= CASE for t in held_out.HARMFUL) >= 0.7 * len(held_out.HARMFUL)
    assert sum(g.score(t)[0] >= CASE for t in held_out.HARMLESS) <= 0.05 * len(held_out.HARMLESS)


def test_composed_transducers():
    s = Symbols()
    first = Transducer(s, [("NP", 0.5, "ADJ+ N")])
    second = Transducer(s, [("HIT", 1.0, "Y -2 NP"), ("OPT", 1.0, "Y -1 VERY* N END?")])
    lattice = [[(i + 1, s[x], 0.0)] for i, x in enumerate(["Y", "O", "ADJ", "ADJ", "N"])]
    present = first.write(lattice, s.mask("Y|O|ADJ|N"))
    assert [(r.out, a, b, w) for r, a, b, w in second.matches(lattice, present)] == [("HIT", 0, 5, 1.5 - SKIP)]
    denied = [[(i + 1, s[x], 0.0)] for i, x in enumerate(["Y", "NEG", "N"])]
    assert second.matches(denied, s.mask("Y|NEG|N")) == []  # no gap passes over a negation
    assert len(second.matches([[(1, s["Y"], 0.0)], [(2, s["O"], 0.0)], [(3, s["N"], 0.0)]], s.mask("Y|O|N"))) == 1


@pytest.mark.parametrize("text", ["Fuck you!", "You idiot!", "Brasko: stupid cunt", "Shut up, you moron. Worthless idiots.", "We met at noon. You are a\nstupid moron and everyone knows it.", "Du bist ein\r\n  Arschloch"])
def test_short_and_wrapped_sentences_are_scored(text):
    assert grammar().score(text)[0] >= CASE


@pytest.mark.parametrize("text", ["What they saw was a\n- moron", "Seen by you\nBrasko: idiot is not a word here.", "It was a lazy\n12:30 idiot test", "They know you\n2. idiot is a word", "They know you.\nidiot is a word", "They know you\n\nidiot is a word"])
def test_lines_of_their_own_are_not_joined(text):
    assert grammar().score(text)[0] < CASE


def test_scores_cover_every_row_and_whole_texts(spark):
    rows = [(1, "fine " * 30000 + ". You are a stupid moron."), (2, None), (2, None), (3, "")]
    got = with_abuse_score(spark.createDataFrame([(*r, "x") for r in rows], "i int, text string, score string"), "text").collect()
    assert len(got) == 4 and [r["abuse_score"] >= CASE for r in sorted(got, key=lambda r: r["i"])] == [True, False, False, False]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data here")
def test_agreement_with_the_raters(spark):
    import __spark_entry__ as e
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{sf}/content_labels.parquet").filter("harmful IS NOT NULL").groupBy("doc_id").agg(F.avg("harmful").alias("h"))
    r = e.queries()["p10_scores"](spark, sf).join(lab, "doc_id").select((F.col("abuse_score") >= CASE).alias("found"), (F.col("h") > 0.5).alias("said")).collect()
    assert sum(x["found"] == x["said"] for x in r) >= 0.93 * len(r)  # raters err
    assert sum(x["found"] and not x["said"] for x in r) <= 0.02 * len(r)
