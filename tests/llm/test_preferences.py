from slotledger.llm.preferences import preference_pairs

SCHEMA = "pair_id long, side int, turn long, role string, text string, c string, r string, prompt string"


def pairs(spark, rows):
    return {r.pair_id: r for r in preference_pairs(spark.createDataFrame([(*x, "c", "r", "p") for x in rows], SCHEMA)).collect()}


def test_prefix_completions_and_masks(spark):
    found = pairs(spark, [
        (1, 0, 0, "user", "hi"), (1, 0, 1, "assistant", "yes"), (1, 0, 2, "user", "ok"), (1, 0, 3, "assistant", "bye"),
        (1, 1, 1, "assistant", "no"), (1, 1, 0, "user", "hi"),
    ])
    r = found[1]
    assert r.prompt_turns == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert r.rejected == "<|im_start|>assistant\nno<|im_end|>\n"
    assert [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["no<|im_end|>\n"]
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["yes<|im_end|>\n", "bye<|im_end|>\n"]


def test_equal_turns_after_a_difference_are_no_prefix(spark):
    found = pairs(spark, [(1, s, t, "user", x) for s, texts in enumerate(("abc", "axc")) for t, x in enumerate(texts)])
    assert found[1].prompt_turns == 1


def test_roles_matter_and_one_may_begin_the_other(spark):
    found = pairs(spark, [
        (1, 0, 0, "user", "a"), (1, 1, 0, "assistant", "a"),
        (2, 0, 0, "user", "a"), (2, 1, 0, "user", "a"), (2, 1, 1, "assistant", "b"),
    ])
    assert found[1].prompt_turns == 0 and found[1].prompt == "" and found[1].chosen_mask == []
    assert found[2].prompt_turns == 1 and found[2].chosen == "" and found[2].rejected.endswith("b<|im_end|>\n")


def test_nulls_repeats_lone_sides_and_empty_tables(spark):
    found = pairs(spark, [
        (1, 0, None, None, None), (1, 0, 0, "user", "a"), (1, 0, 0, "user", "a"), (1, 1, None, None, ""), (1, 1, 0, "user", "é"),
        (2, 0, 0, "assistant", "x" * 50_000), (3, 1, 0, "assistant", "é🙂"), (None, 0, 0, "user", "a"), (4, 5, 0, "user", "a"),
    ])
    assert set(found) == {1, 2, 3}
    assert found[1].prompt_turns == 1 and found[1].prompt == "<|im_start|>\n<|im_end|>\n"
    assert found[1].chosen.count("user\na<|im_end|>") == 2
    assert found[2].rejected is None and found[2].rejected_mask is None and found[2].prompt == ""
    assert found[3].chosen is None and [found[3].rejected[s.start : s.end] for s in found[3].rejected_mask] == ["é🙂<|im_end|>\n"]
    assert pairs(spark, []) == {}
