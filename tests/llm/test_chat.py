import hashlib
import random

from inkfall.llm import chat


def test_round_trip(spark):
    random.seed(2)
    bits = ["\\", "#", "##", "###", "### Assistant: ", "</turn>", "</part>", "\n", ": ", ":", " ", "<", "/", "x", "é", "😀", "</turn>\n", "<\\/turn>", "$1"]
    rows = []
    for conv in range(150):
        for turn in range(random.randint(1, 7)):
            text = None if random.random() < 0.05 else "".join(random.choices(bits, k=random.randint(0, 8)))
            role = random.choice(["user", "assistant", "system", None, "a: b:", ":", "###", "\n", "\\"])
            rows.append((conv, None if random.random() < 0.05 else turn // 2 if conv % 5 == 0 else turn, role, text, 1))
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok", 1), (-7, 1, "assistant", r"\### Assistant: </turn> ok", 1), (None, 0, "assistant", "lost", 1), (3, 9, "assistant", "y" * 200_000, 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    formatted = chat.format_chats(turns)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    whole = {r.conv_id: r for r in formatted.collect()}
    by = {}
    for conv, turn, role, text, _ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, some in by.items():
        some.sort()
        told = "".join(f"{r}\n{t}\n" for *_, r, t in some)
        loss = "".join(t for *_, r, t in some if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(some), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text = whole[conv].formatted
        assert r.formatted_chars == len(text)
        roles = [r for *_, r, _ in some]
        assert text.count("</turn>") == 1 + sum(a != b for a, b in zip(roles, roles[1:]))
        assert text.count("##") - 2 * text.count("###") == -text.count("###") and text.count("###") == text.count("</turn>")


def test_empty_table(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
