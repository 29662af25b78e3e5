from flowlake.llm import quotation

ROWS = [
    (1, 0, "user", "Hello there\nhow are you?"),
    (1, 1, "assistant", "On Monday, A wrote:\n> Hello   there\n> how are you?\n\nFine, thanks"),
    (1, 2, "user", ">> hello there\n>> how are you?\n> Fine, thanks\nGood"),
    (1, 3, "user", "> Hello there\nback to the first"),
    (2, 0, "user", "> never written by anyone\nanswer"),
    (2, 1, "user", "> Good\nforwarded"),
    (2, 2, "user", None),
    (2, 3, "user", ""),
    (2, 2, "user", "second row of one place"),
    (None, 0, "user", "no conversation"),
    (3, None, "user", "> no conversation\nno turn"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], "conv_id long, turn long, role string, text string, lines string, id string")


def test_trees_positions_and_bodies(spark):
    found = quotation.conversations(table(spark)).collect()
    got = {(r.conv_id, r.turn, r.body): (r.root_conv, r.root_turn, r.position, r.depth, r.parent_conv, r.parent_turn, r.levels) for r in found}
    assert len(found) == len(ROWS)
    assert got == {
        (1, 0, "Hello there\nhow are you?"): (1, 0, 0, 0, None, None, 0),
        (1, 1, "Fine, thanks"): (1, 0, 1, 1, 1, 0, 1),
        (1, 2, "Good"): (1, 0, 2, 2, 1, 1, 2),
        (1, 3, "back to the first"): (1, 0, 3, 1, 1, 0, 1),
        (2, 0, "answer"): (2, 0, 0, 0, None, None, 1),
        (2, 1, "forwarded"): (1, 0, 4, 3, 1, 2, 1),
        (2, 2, ""): (2, 2, 0, 0, None, None, 0),
        (2, 2, "second row of one place"): (2, 2, 0, 0, None, None, 0),
        (2, 3, ""): (2, 3, 0, 0, None, None, 0),
        (None, 0, "no conversation"): (None, 0, 0, 0, None, None, 0),
        (3, None, "no turn"): (None, 0, 1, 1, None, 0, 1),
    }


def test_long_chain_repeated_rows_and_empty_table(spark):
    chain = [(5, k, "user", (f"> text number {k - 1}\n" if k else "") + f"text number {k}") for k in range(70)]
    found = {r.turn: r for r in quotation.conversations(table(spark, chain + chain[3:5])).collect()}
    assert all((r.position, r.depth, r.body) == (k, k, f"text number {k}") for k, r in found.items()) and len(found) == 70
    assert quotation.conversations(table(spark, [])).count() == 0


def test_very_long_text(spark):
    body = "\n".join(f"line {k}" for k in range(5000))
    rows = [(1, 0, "user", body), (1, 1, "user", "\n".join("> " + x for x in body.split("\n")) + "\nshort")]
    found = {r.turn: r for r in quotation.conversations(table(spark, rows)).collect()}
    assert found[1].body == "short" and found[1].parent_turn == 0 and found[1].n_quoted == 5001
