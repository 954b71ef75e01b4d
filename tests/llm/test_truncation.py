"""Cut texts planted among whole ones of the same corpus, and the cases that are none."""

from __future__ import annotations

import random

import pytest

from scriptorium.llm import truncation as C

NAMES = ["Halfen", "Ondzet", "Teviss", "Radrel"]
NOUNS = ["lantern", "kitchen", "harbour", "photograph", "mountain", "envelope"]
VERBS = ["borrow", "deliver", "repair", "forgive", "trust"]


def sentence(rng):
    return rng.choice(
        [
            f"Would you {rng.choice(VERBS)} the {rng.choice(NOUNS)} for {rng.choice(NAMES)} tomorrow?",
            f"They found the {rng.choice(NOUNS)} under the {rng.choice(NOUNS)} near the {rng.choice(NOUNS)}.",
            f"Nobody could ever {rng.choice(VERBS)} such a wonderful {rng.choice(NOUNS)} here.",
        ]
    )


def whole(rng, cues):
    blocks = [f"{i}\n00:{i % 60:02}:01,100 --> 00:{i % 60:02}:04,250\n{sentence(rng)}" for i in range(1, cues + 1)]
    return "\n\n".join(blocks) + rng.choice(["", "\n"])


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows, cut = [], set()
    for doc in range(400):
        text = whole(rng, rng.randint(3, 30))
        end = rng.choice(["", "", "", "\n\n99\n00:59:01,100 --> 00:59:04,250\nTHE END", "\n\n99\n00:59:01,100 --> 00:59:04,250\n[DOOR CREAKS]", "\n\n99\n00:59:01,100 --> 00:59:04,250\nI told you to—"])
        rows.append((doc, text.rstrip("\n") + end if end else text, f"src{doc % 5}", len(text)))
    for doc in range(1000, 1080):
        text = whole(rng, 30)
        kind = doc % 4
        if kind == 0:
            text, source = text[:900], " SRC7 "  # a limit of the source
        elif kind == 1:
            text, source = text[: rng.randrange(400, 800)], "src1"
            while not (text[-1].isalpha() and text.rsplit(None, 1)[-1] in {w[:k] for w in NOUNS + VERBS for k in range(3, len(w) - 1)}):
                text = whole(rng, 30)[: rng.randrange(400, 800)]
        elif kind == 2:
            at = text.index("-->", rng.randrange(300, 900))
            text, source = text[: at + rng.randrange(-6, 9)], "src2"
        else:
            text, source = text[:799].rstrip() + "…", "src8"
            text = text[:-1] + "x" * (800 - len(text)) + "…"
        cut.add(doc)
        rows.append((doc, text, source, len(text)))
    rows += [(2000, None, "src1", None), (2001, "", "src1", 0), (2002, " \n\t", None, 3), (2003, "just one line", None, 13), (2004, "1\n00:00:01,000 --> 00:00:02,000\nHi.", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint"), cut


def test_planted_cuts(corpus):
    frame, cut = corpus
    got = {r["doc_id"] for r in C.truncated(frame).select("doc_id").collect()}
    assert len(got & cut) / len(cut) >= 0.95
    assert len(got - cut) <= 0.02 * 400


def test_sources(corpus):
    rows = {r["source"]: r for r in C.truncation_by_source(corpus[0]).collect()}
    assert rows["src7"]["truncated"] == rows["src7"]["documents"] == 20 and rows["src7"]["share"] == 1.0
    assert rows[None]["documents"] == 3
    assert sum(r["documents"] for r in rows.values()) == corpus[0].count()


def test_parts():
    def part(text):
        return C.breaks_off(C.cue_texts(text))

    head = "1\n00:00:01,000 --> 00:00:02,000\nHi there.\n\n"
    assert part(head + "2\n00:00:0") == "timing" and part(head + "2\n00:00:03,100 --") == "timing"
    assert part(head + "2") == "number" and part(head + "2\n00:00:03,100 --> 00:00:04,100") == "text"
    assert part(head + "2\n00:00:03,100 --> 00:00:04,100\n<i>so <fo") == "bracket"
    assert part(head + "2\n00:00:03,100 --> 00:00:04,100\n42") == "" and part(head) == ""


def test_empty_and_extra_columns(spark):
    frame = spark.createDataFrame([(1, "a", "b", 1, "w", 2)], "doc_id bigint, text string, source string, n_chars bigint, word string, chars int")
    assert C.truncated(frame).count() == 0
    assert C.truncated(frame.limit(0)).count() == 0 and C.truncation_by_source(frame.limit(0)).count() == 0


def test_fragments_that_files_share(spark):
    """Many files cut after the same letters are all found; a closing title that is no word of the corpus isn't one."""
    rng = random.Random(3)
    rows = [(doc, whole(rng, 12).rstrip("\n"), "src1", None) for doc in range(300)]
    end = "\n\n99\n00:59:01,100 --> 00:59:04,250\n"
    rows += [(1000 + k, whole(rng, 12).rstrip("\n") + end + "Wou", "src1", None) for k in range(6)]
    rows += [(2000 + k, whole(rng, 12).rstrip("\n") + end + "Wo", "src1", None) for k in range(6)]
    rows += [(3000 + k, whole(rng, 12).rstrip("\n") + end + "Fou", "src1", None) for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint").repartition(4)
    got = {r["doc_id"] for r in C.truncated(frame).collect()}
    assert got & set(range(1000, 4000)) == {*range(1000, 1006), *range(2000, 2006)}
