from __future__ import annotations

from strataframe.llm import leakage as L

ITEM = [f"i{k}" for k in range(60)]


def share(doc):
    return L.leaks(L.compile_items([(1, ITEM)]), list(doc))


def test_repeats_elsewhere_do_not_part_a_stretch():
    passage = [*ITEM[20:29], "more", *ITEM[29:38]]  # neither half has ten words
    phrase = [w for k in range(9) for w in (*ITEM[22:26], f"x{k}", f"y{k}")]
    assert share(passage) == [(1, 0.3)]
    assert share([*phrase, *passage]) == share([*passage, "z", *phrase]) == [(1, 0.3)]
    assert share([w for k in range(10) for w in (*passage, f"x{k}", f"y{k}", f"z{k}")]) == [(1, 0.3)]

