import random

import pytest

from spandrel.llm import leakage as K
from spandrel.llm import subtitles

ITEM = "The council of Halsolven paid Merlumwen Uldusvey exactly 812 coins for every panel of brass bells. In the archive of Corlumholm lies a panel of 258 glass seeds that Fenborwen Niduskan catalogued in 1483."
OTHER = "The council of Bavenbor paid Grimirwen Tordus exactly 293 coins for every drawer of brass bells. In the archive of Venfetnis lies a ledger of 550 glass seeds that Osmon Ullobor catalogued in 1751."
FIRST = "Nobody in Gribor could explain why Doniswen Zanbormir painted 415 amber lenses on one drawer before noon."
A = K.Automaton([(1, ITEM), (2, FIRST)])


def cues(lines, start=3, sep="\n"):
    return (sep + sep).join(f"{i + start}{sep}00:00:{i:02d},000 --> 00:00:{i + 1:02d},500{sep}{line}" for i, line in enumerate(lines)) + sep


def found(text, least=12):
    return {(i, n) for i, n, *_ in K.shown_in(text, A, least)}


def parted(text, size=5):
    w = text.split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size)]


def test_whole_and_part():
    assert found(cues(["Hello there.", *parted(ITEM), "Good night."])) == {(1, 34)}
    assert found(cues(parted(" ".join(ITEM.split()[:12])))) == {(1, 12)}
    assert found(cues(parted(" ".join(ITEM.split()[:11])))) == set()
    assert found(ITEM) == {(1, 34)}


@pytest.mark.parametrize(
    "change",
    [
        str.upper, lambda t: t.replace(" ", " "), lambda t: t.replace("l", "I"), lambda t: t.replace("m", "rn"), lambda t: t.replace("brass bells", "brassbells").replace("of Hal", "ofHal"),
        lambda t: t.replace("panel", "pa-\nnel"), lambda t: t.replace("a", "a​"), lambda t: t.replace("exactly ", ""), lambda t: t.replace("archive", "well, archive"), lambda t: t.replace(".", ""),
        lambda t: f"<i>{t}</i>", lambda t: t.replace("of ", "of (SIGHS) "),
    ],
)
def test_damage_does_not_matter(change):
    assert {i for i, _ in found(cues([change(x) for x in parted(ITEM, 6)]))} == {1}
    assert {i for i, _ in found(cues([change(ITEM)], sep="\r\n"))} == {1}


def test_speakers_and_repeated_lines():
    lines = [f"- HARSOL: {x}" for x in parted(ITEM)]
    assert {i for i, _ in found(cues(lines))} == {1}
    rolled = [a + "\n" + b for a, b in zip(parted(ITEM), parted(ITEM)[1:])]
    assert {i for i, _ in found(cues(rolled))} == {1}


def test_no_cases():
    assert found(cues(parted(OTHER))) == set()
    words = ITEM.split()
    random.Random(1).shuffle(words)
    assert found(cues(parted(" ".join(words)))) == set()
    apart = [x for p in parted(" ".join(ITEM.split()[:20])) for x in (p, f"Did you see {p.split()[-1]} and the old lighthouse over there?")]
    assert found(cues(apart)) == set()
    assert found("") == set() and found(" \n ") == set() and K.shown_in("x", K.Automaton([]), 12) == [] and K.shown_in("x", K.Automaton([(1, "")]), 12) == []


def test_offsets_and_garbled_text():
    item = "Dans les archives de Gulnisgarholm se trouve un casier de 129 grelots dorés que Harlumbor Dalhulfet classa très tôt"
    a = K.Automaton([(7, item)])
    text = cues(["Écoute-moi bien !", item.encode().decode("latin-1")])
    ((i, n, lo, hi),) = K.shown_in(text, a, 12)
    assert (i, n) == (7, 19) and text[lo : lo + 4] == "Dans" and text[hi] in "t"
    assert subtitles.ungarbled("fÃ¼r Ã\x83Â©t") == "für ét"


@pytest.mark.parametrize("whole", [True, False])
def test_alignment_against_plain_dynamic_programme(whole):
    r = random.Random(4)
    for _ in range(40):
        x, y = ("".join(r.choice("abc") for _ in range(r.randrange(1, 25))) for _ in range(2))
        best = [[-2 * (i + j) for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                best[i][j] = max(best[i - 1][j - 1] + (3 if x[i - 1] == y[j - 1] else -3), best[i - 1][j] - 2, best[i][j - 1] - 2)
        hit = [(i, p) for i, p in enumerate(K.aligned(x, y, whole)) if p >= 0]
        assert all(x[i] == y[p] for i, p in hit) and all(a[1] < b[1] for a, b in zip(hit, hit[1:]))
        want = best[-1][-1] if whole else max(map(max, best))
        # what is between two hits is aligned at best with pairs of other characters
        score, at = 0, (-1, -1)
        for i, p in [*hit, *([(len(x), len(y))] if whole else [])]:
            a, b = i - at[0] - 1, p - at[1] - 1
            score += 3 * (i < len(x)) - 3 * min(a, b) - 2 * abs(a - b)
            at = (i, p)
        assert score == want


def test_common_subsequence():
    assert [K.common(a, b) for a, b in (("abcd", "axbxd"), ("", "a"), ("ab", ""), ("aab", "ba"), ("abab", "baba"))] == [3, 0, 0, 1, 3]


def test_identical_and_moulded_items_are_all_found():
    items = [(k, ITEM) for k in range(5)] + [(10 + k, f"{FIRST} {'xyzuvw'[k] * 9} {k} ends here.") for k in range(6)]
    a = K.Automaton(items)
    assert {i for i, *_ in K.shown_in(cues(parted(ITEM)), a, 12)} == set(range(5))
    assert {i for i, *_ in K.shown_in(cues(parted(FIRST)), a, 12)} == set(range(10, 16))


def test_very_long_item_and_document():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(20_000)]
    item = " ".join(words)
    a = K.Automaton([(1, item)])
    ((i, n, lo, hi),) = K.shown_in(item, a, 12)
    assert (i, n, lo, hi) == (1, 20_000, 0, len(item) - 1)
    assert [x[:2] for x in K.shown_in(cues(words[700:713]), a, 12)] == [(1, 13)]
    assert K.shown_in(cues(words[700:711]), a, 12) == []


@pytest.mark.parametrize("sep", ["\n", "\r\n", "\r"])
def test_line_ends(sep):
    text = cues(parted(ITEM), sep=sep)
    ((i, n, lo, hi),) = K.shown_in(text, A, 12)
    assert (i, n) == (1, 34) and text[lo:].startswith("The council") and text[: hi + 1].endswith("1483")


def test_operator(spark, rows):
    docs = spark.createDataFrame([(1, cues(parted(ITEM)), "x"), (2, cues(parted(OTHER)), "x"), (3, None, "x"), (4, "", "x"), (5, cues(parted(ITEM) + parted(FIRST)), "x"), (1, cues(parted(ITEM)), "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM), (2, FIRST), (3, None), (4, "")], "id bigint, words string")
    for block in (10**6, 150):
        got = rows(K.leaked(docs.select("doc_id", "text"), "doc_id", "text", items, "id", "words", block_chars=block).select("doc_id", "id"))
        assert got == [(1, 1), (1, 1), (5, 1), (5, 2)]
    assert K.leaked(docs.select("doc_id", "text"), "doc_id", "text", items.limit(0), "id", "words").count() == 0


def test_passages_of_many_items_are_found_for_each():
    items = [(k, f"{ITEM} {x}") for k, x in enumerate(("", "Ends one way.", "Other end here.", "Third end there."))]
    a = K.Automaton(items)
    text = cues(parted(" ".join(ITEM.split()[:14])))
    assert {i for i, *_ in K.shown_in(text, a, 12)} == {0, 1, 2, 3}


def test_results_do_not_depend_on_blocks(spark, rows):
    docs = spark.createDataFrame([(1, cues(parted(" ".join(ITEM.split()[:14])))), (2, cues(parted(FIRST))), (3, cues(parted(OTHER)))], "doc_id bigint, text string")
    items = spark.createDataFrame([(k, f"{ITEM} Ending {k}.") for k in range(5)] + [(8, FIRST)], "id bigint, words string")
    for block in (10**6, 400, 150):
        got = rows(K.leaked(docs, "doc_id", "text", items, "id", "words", block_chars=block).select("doc_id", "id"))
        assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 8)]
    a, b = K.Automaton([(8, FIRST)], shared=set(K.anchors(K.Item(8, FIRST)))), K.Automaton([(8, FIRST)])
    assert {i for i, *_ in K.shown_in(FIRST, a, 12)} == {i for i, *_ in K.shown_in(FIRST, b, 12)} == {8}


@pytest.mark.parametrize("first, damaged", [(7, (2, 5, 8)), (17, (3, 6, 9))])
def test_several_damaged_words_of_twelve(first, damaged):
    words = ITEM.split()[first : first + 12]
    for k in damaged:  # one character of each amiss
        words[k] = words[k][:2] + "x" + words[k][3:] if len(words[k]) > 3 else words[k]
    assert found(cues(parted(" ".join(words)))) == {(1, 12)}
