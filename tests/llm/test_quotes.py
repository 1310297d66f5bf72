from tickloom.llm import quotes as C
from tickloom.llm.common import prefix_max

SCHEMA = "conv_id long, turn long, role string, text string, hash string, position int"


def chats(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return C.format_chats(df)


def test_replies_follow_what_they_quote(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?\n\nSecond paragraph here"),
        (1, 1, "assistant", "> Hello there. How\n> are you?\nFine."),
        (1, 2, "user", "> > Hello there.\n> > How are you?\n> Fine.\nGood to hear"),
        (1, 3, "user", ">Second   PARAGRAPH here\nyes"),
        (1, 4, "user", "a new thread"),
        (2, 0, "user", "> Good to hear\nfrom elsewhere\n> never said by anyone"),
    ]
    got = [r.asDict() for r in chats(spark, rows).orderBy("conv_id", "position").collect()]
    one = [(r["turn"], r["text"], r["reply_to_turn"], r["root_turn"], r["depth"], r["n_quoted"], r["n_linked"]) for r in got if r["conv_id"] == 1]
    assert one == [
        (0, rows[0][3], None, 0, 0, 0, 0),
        (1, "Fine.", 0, 0, 1, 1, 1),
        (3, "yes", 0, 0, 1, 1, 1),
        (2, "Good to hear", 1, 0, 2, 2, 2),
        (4, "a new thread", None, 4, 0, 0, 0),
    ]
    other = [r for r in got if r["conv_id"] == 2][0]
    assert (other["reply_to_conv"], other["reply_to_turn"], other["n_quoted"], other["n_linked"], other["depth"]) == (1, 2, 2, 1, 0)
    assert other["text"] == "from elsewhere"


def test_long_chains_and_one_passage_said_by_all(spark):
    n = 70
    rows = [(5, 0, "user", "say 0 it")] + [(5, i, "user", f"> say {i - 1} it\nsay {i} it") for i in range(1, n)]
    rows += [(6, i, "user", "thanks") for i in range(n)] + [(6, n, "user", "> thanks\nwelcome")]
    got = {(r["conv_id"], r["turn"]): r for r in chats(spark, rows).collect()}
    for i in range(n):
        assert (got[5, i]["depth"], got[5, i]["root_turn"], got[5, i]["position"]) == (i, 0, i)
    assert got[6, n]["reply_to_turn"] == n - 1  # the latest of the equal ones


def test_other_conversations_on_both_sides(spark):
    rows = [
        (3, 1, "user", "> The kettle is on the stove\nok"), (7, 0, "user", "The kettle is on the stove"),
        (9, 4, "user", "> The kettle is on the stove\nagain"), (7, 5, "user", "> The kettle is on the stove\nindeed"),
        (8, 0, "user", "> said only here now\nsaid only here now"), (2, 3, "user", "> thanks\nwelcome"), (1, 0, "user", "thanks"),
        (None, 2, "user", "> The kettle is on the stove\nlost"),
    ]
    got = {r["conv_id"]: r for r in chats(spark, rows).where("n_quoted > 0").collect()}
    link = lambda c: (got[c]["reply_to_conv"], got[c]["reply_to_turn"])
    assert link(3) == link(9) == link(7) == link(None) == (7, 0)
    assert link(8) == (None, None)  # nobody else says it
    assert link(2) == (None, None)  # one word does not tie conversations
    assert got[3]["depth"] == 0 and got[7]["depth"] == 1


def test_sentences_out_of_longer_lines(spark):
    rows = [
        (1, 0, "user", "It rains today. The bridge is closed\nuntil the river falls. Take the ferry instead!"),
        (1, 1, "user", "> The bridge is closed until the river falls.\nSince when?"),
        (1, 2, "user", "> Take the ferry\n> instead!\nYes."),
        (2, 0, "user", "> It rains today.\n> Take the ferry instead!\nBoth."),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in chats(spark, rows).collect()}
    for at in ((1, 1), (1, 2), (2, 0)):
        assert (got[at]["reply_to_conv"], got[at]["reply_to_turn"], got[at]["n_linked"]) == (1, 0, 1)


def brute_far(rows):
    """The first other conversation that says a quoted line of three words, where the own one has not said it before."""
    said = {(c, t): {x for x in text.split("\n") if not x.startswith(">")} for c, t, _, text in rows}
    out = {}
    for c, t, _, text in rows:
        for line in text.split("\n"):
            if line.startswith("> ") and not any(k[0] == c and k[1] < t and line[2:] in v for k, v in said.items()):
                out[c, t] = min((k for k, v in said.items() if k[0] != c and line[2:] in v), default=(None, None))
    return out


def test_lines_of_other_conversations_against_loops(spark):
    import random

    r = random.Random(5)
    lines = [f"line {a} of {b}" for a in "abcd" for b in "xyz"]
    rows = [(c, t, "user", (f"> {r.choice(lines)}\n" if r.random() < 0.5 else "") + r.choice(lines)) for c in range(12) for t in range(4)]
    got = {(x["conv_id"], x["turn"]): (x["reply_to_conv"], x["reply_to_turn"]) for x in chats(spark, rows).collect()}
    want = brute_far(rows)
    assert len(want) > 10 and {k: got[k] for k in want} == want


def brute_links(rows):
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    own = {}
    for conv, turn, _, text in rows:
        for line in (text or "").split("\n"):
            if not line.startswith(">") and norm(line):
                own.setdefault((conv, norm(line)), []).append(turn)
    out = {}
    for conv, turn, _, text in rows:
        for line in (text or "").split("\n"):
            if line.startswith(">"):
                before = [t for t in own.get((conv, norm(line)), []) if t < turn]
                out[conv, turn] = max(before, default=None)
                break
    return out


def test_single_lines_against_loops(spark):
    import random

    r, rows = random.Random(8), []
    for conv in range(6):
        said = []
        for turn in range(15):
            line = f"{r.choice('abc')} line {r.randrange(6)}"
            quote = f"> {r.choice(said)}\n" if said and r.random() < 0.6 else ""
            rows.append((conv, turn, "user", quote + line))
            said.append(line)
    got = {(x["conv_id"], x["turn"]): x["reply_to_turn"] for x in chats(spark, rows).collect()}
    want = brute_links(rows)
    assert want and all(got[k] == v for k, v in want.items())
    assert all(v is None for k, v in got.items() if k not in want)


def test_a_hot_key_is_met_across_sort_partitions(spark):
    # One key holds most rows, one is null, and one owns nothing.
    rows = [(("hot", None, "bare")[i % 3 if i % 10 == 0 else 0], i, i if i % 4 == 0 and i % 3 != 2 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, turn long, own long").repartition(8)
    got = {(r["key"], r["turn"]): r["near"] for r in prefix_max(df, ["key"], ["turn"], "own", "near").collect()}
    assert len(got) == len(rows)
    last = {}
    for key, turn, own in rows:
        assert got[key, turn] == last.get(key)
        last[key] = last.get(key) if own is None else own
    assert "bare" not in last or last["bare"] is None


def test_odd_rows(spark):
    rows = [(None, None, None, "> x"), (2, 1, "a", None), (2, 1, "a", None), (2, 2, "a", ""), (3, 0, "u", ">\n> \n"), (3, None, "u", "no turn"), (4, 0, "u", "w " * 100_000)]
    got = chats(spark, rows).collect()
    assert len(got) == len(rows)
    assert sorted(r["position"] for r in got if r["conv_id"] == 2) == [0, 1, 2]
    assert [r["text"] for r in got if r["conv_id"] == 2].count(None) == 2
    assert chats(spark, []).count() == 0
