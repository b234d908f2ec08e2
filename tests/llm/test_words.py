import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é😀\n\t\x0b\x00x　", max_size=60)), max_size=12)


@settings(deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    words = W.Texts(pa.array(texts, pa.string())).words()
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    data = words.texts.data.tobytes()
    found = [data[a:b].decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert found == [w for ws in want for w in ws]
    assert words.per_text.tolist() == [len(w) for w in want]
    hashes = words.hashes()
    assert len(set(zip(hashes.tolist(), found, strict=True))) == len(set(found)) == len(set(hashes.tolist()))


@settings(deadline=None)
@given(TEXTS)
def test_windows_with_short_texts(texts):
    words = W.Texts(pa.array(texts, pa.string())).words()
    value, owner, _ = W.windows(words, words.hashes(), 3, short=True)
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    want = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()} for w in split]
    assert [len(np.unique(value[owner == i])) for i in range(len(texts))] == [len(s) for s in want]


def test_a_long_word_is_hashed_by_all_its_bytes():
    base = "y" * 20_000
    texts = pa.array([base, base[:-1] + "z", base[:9000] + "z" + base[9001:], base])
    a, b, c, d = W.Texts(texts).words().hashes().tolist()
    assert a == d and len({a, b, c}) == 3


def test_hashes_do_not_depend_on_the_other_texts():
    alone = W.Texts(pa.array(["one two"])).words().hashes().tolist()
    assert W.Texts(pa.array(["one two", "y" * 9000])).words().hashes().tolist()[:2] == alone


def test_runs_are_hashed_without_what_stands_between():
    one = W.Texts(pa.array(["ab, cd!!", "x"]))
    two = W.Texts(pa.array(["ab", "cd...", "x--"]))
    assert one.letter_runs().hashes().tolist() == two.letter_runs().hashes().tolist()
