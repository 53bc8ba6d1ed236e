import random
import re

from corpusloom.llm import chats

SCHEMA = "conv_id long, turn long, role string, text string, reply_to int, thread string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(3)


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", "How do I sort a table?\nIt is large and lies on disk."),
        (1, 1, "assistant", "Which engine do you use today?"),
        (1, 2, "user", "> Which engine\n> do you use today?\nSpark, of course."),
        (1, 3, "assistant", "On 1 May, Ann wrote:\r\n> How do I SORT a table?\r\n\r\nUse order by.\r\n\r\n\r\n\r\nDone."),
        (1, 4, "user", ">> How do I sort a table?\n> Use order by.\n\nThat was slow."),
        (1, 5, "user", "> Spark, of course."),
        (1, 6, "user", "> nobody ever wrote this line\nwhat?"),
        (2, 0, "user", "> How do I sort a table?\nother conversation"),
        (2, 1, "user", None), (None, 3, "user", "> How do I sort a table?"), (2, None, "user", "How do I sort a table?"),
        (3, 0, "a", "same line again and again"), (3, 1, "a", "same line again and again"), (3, 2, "a", "> same line again and again\nyes"),
        (3, 2, "a", "> same line again and again\nyes"), (4, 0, "a", "x" * 200_000), (4, 1, "a", "> " + "x" * 200_000 + "\nwell"),
    ]
    got = chats.link_quotes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert {k: r.reply_to for k, r in by.items() if r.reply_to is not None} == {
        (1, 2): 1, (1, 3): 0, (1, 4): 3, (1, 5): 2, (3, 2): 0, (4, 1): 0,
    }
    assert by[1, 4].thread == 0 and by[1, 5].thread == 1 and by[1, 5].depth == by[1, 4].depth == 2
    assert by[1, 3].text == "Use order by.\n\nDone." and by[1, 4].text == "That was slow." and by[1, 5].text == "" and by[1, 2].text == "Spark, of course."
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.thread, r.turn))]
    assert order == [0, 3, 4, 1, 2, 5, 6]
    assert by[2, 1].text == "" and by[None, 3].thread is None and by[1, 6].thread == 6 and by[1, 6].reply_to is None and by[1, 6].n_quoted == 1
    assert chats.link_quotes(frame(spark, [])).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, i, "u", (f"> message number {i - 1} of the chain\n" if i else "") + f"message number {i} of the chain") for i in range(70)]
    got = chats.link_quotes(frame(spark, rows)).collect()
    assert all((r.thread, r.depth) == (0, r.turn) for r in got)


def test_given_conversations_keep_their_texts(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.text for r in chats.link_quotes(given).collect()}
    assert got == {(r.conv_id, r.turn): r.text.strip() for r in given.collect()}


def test_short_quotes_link(spark):
    said = ["Y", "No", "Why", "Okay", "Quite", "Thanks", "Yes, do.", "Why so?", "Not today", "Tomorrow ok", "明日は雨です。", "好"]
    rows = [(n, 0, "u", text) for n, text in enumerate(said)] + [(n, 1, "a", f"> {text}\nreply") for n, text in enumerate(said)]
    rows += [(90, 0, "u", "?!"), (90, 1, "a", "> ?!\nreply"), (91, 0, "u", "Yes."), (91, 1, "a", "A much longer line.\nNo."), (91, 2, "u", "> Yes.\n\n> A much longer line.\nreply")]
    got = {(r.conv_id, r.turn): r.reply_to for r in chats.link_quotes(frame(spark, rows)).collect()}
    assert all(got[n, 1] == 0 for n in range(len(said))) and got[90, 1] is None and got[91, 2] == 1


def words_of(text):
    return re.sub(r"[\s!-/:-@\[-`{-~]+", " ", text.lower(), flags=re.ASCII).strip(" ")


def brute_replies(rows):
    """Each message's quotes and own passages compared with all earlier ones, from the definition."""
    said: dict = {}
    quoted: dict = {}
    for conv, turn, _, text in rows:
        lines = [(lambda m: (m[0].count(">"), line[m.end() :]))(re.match(r"(?:(?:[ \t]*>)+[ \t]?)?", line)) for line in text.split("\n")]
        runs: list = []
        for level, content in lines:
            if runs and runs[-1][0] == level and content.strip(" "):
                runs[-1] = (level, runs[-1][1] + "\n" + content)
            else:
                runs.append((level, content))
        own = "\n".join(content for level, content in lines if level == 0)
        for level, content in {(level, words_of(content)) for level, content in [*runs, *lines, (0, own)]}:
            if content:
                (said if level == 0 else quoted).setdefault((conv, turn), set()).add((level, content))
    out = {}
    for (conv, turn), parts in quoted.items():
        votes: dict = {}
        for level, words in parts:
            first = min((t for (c, t), own in said.items() if c == conv and (0, words) in own), default=None)
            if first is not None and first < turn:
                votes[level, first] = votes.get((level, first), 0) + len(words)
        if votes:
            out[conv, turn] = max((-level, chars, first) for (level, first), chars in votes.items())[2]
    return out


def random_conversations(seed, convs, turns):
    draw = random.Random(seed)
    rows = []
    for conv in range(convs):
        texts: list = []
        for turn in range(turns):
            lines = [" ".join(draw.choices("red Blue green. old, new".split(), k=draw.randint(1, 3))) for _ in range(draw.randint(0, 3))]
            for _ in range(draw.randint(0, 2)):
                if texts:
                    source = draw.choice(texts).split("\n")
                    at = draw.randrange(len(source))
                    lines[draw.randint(0, len(lines)) : 0] = [draw.choice(["> ", ">", " > "]) + x for x in source[at : at + draw.randint(1, 3)]]
            texts.append("\n".join(lines))
            rows.append((conv, turn, "u", texts[-1]))
    return rows


def test_links_equal_brute_force(spark):
    rows = random_conversations(3, 12, 14)
    want = brute_replies(rows)
    got = {(r.conv_id, r.turn): r for r in chats.link_quotes(frame(spark, rows)).collect()}
    assert {k: r.reply_to for k, r in got.items() if r.reply_to is not None} == want and len(want) > 60
    for (conv, turn), r in got.items():
        chain = [turn]
        while (conv, chain[-1]) in want:
            chain.append(want[conv, chain[-1]])
        assert (r.thread, r.depth) == (chain[-1], len(chain) - 1)


def test_one_target_of_most_replies_and_a_long_message(spark):
    rows = [(1, 0, "u", "What do you all think?")] + [(1, i, "a", f"> What do you all think?\nopinion {i}") for i in range(1, 400)]
    rows += [(2, 0, "u", "\n".join(f"line {i}" for i in range(100_000))), (2, 1, "a", "> line 77\nright")]
    rows += [(3, 1, "a", "> again\nsame turn")] * 50 + [(3, 0, "u", "again")]
    got = chats.link_quotes(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.reply_to == 0 and r.thread == 0 and r.depth == 1 for r in got if r.turn)
