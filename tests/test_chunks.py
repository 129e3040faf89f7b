"""Chunkers against plain loops and examples."""

import random
import re

from corpusloom.functions import text as T


def plain(text, size):
    """Chunks by hand: one pass over paragraphs and sentences with a text that grows."""
    most, chunks, now = 3 * size, [], ""
    paragraphs = [p.strip() for section in re.split(r"\n(?=#\s+)", text) for p in section.strip().split("\n\n") if p.strip()]
    for p in paragraphs:
        if len(p) <= most:
            if len(now) >= most // 2 and len(now) + len(p) > most:
                chunks.append(now.strip())
                part = int(len(now) * 0.15)
                now = (now[-part:] if part else now) + "\n\n" + p
            else:
                now = now + "\n\n" + p if now else p
            continue
        if now:
            chunks.append(now.strip())
            now = ""
        at = 0
        for m in re.finditer(r"[。！？.!?]+", p):
            body, at = p[at : m.start()].strip(), m.end()
            if not body:
                continue
            sentence = body + m[0]
            if len(sentence) > most:
                chunks.append(sentence[:most])
            elif len(now) + len(sentence) > most:
                chunks += [now.strip()] if now else []
                now = sentence
            else:
                now += sentence
    return chunks + ([now.strip()] if now.strip() else [])


def test_recursive_chunks_are_a_plain_pass():
    rnd = random.Random(3)
    for _ in range(3000):
        size = rnd.choice([1, 2, 3, 5, 10, 20])
        pieces = ["a" * rnd.randrange(1, 12), ". ", "! ", "。", "\n\n", "\n# h\n", "\n", " ", "b" * rnd.randrange(1, 70) + "."]
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(30)))
        assert T.recursive_chunks(text, size) == plain(text, size), (size, text)


def test_recursive_chunks_examples():
    # a half-full chunk closes and hands 15 percent on; a long paragraph goes by sentences
    assert T.recursive_chunks("aaaaaaaaaa\n\nbbbbbbbbbb\n\ncccccccccc", 5) == ["aaaaaaaaaa", "a\n\nbbbbbbbbbb", "b\n\ncccccccccc"]
    assert T.recursive_chunks("One two. Three four! Five", 5) == ["One two.", "Three four!"]
    assert T.recursive_chunks("x" * 40 + ". y.", 5) == ["x" * 15, "y."]
    assert T.recursive_chunks(" \n\n ", 5) == []


def test_split_chunks_lose_nothing_and_keep_their_size():
    rnd = random.Random(4)
    for _ in range(400):
        text = "".join(rnd.choice(["word ", "longer-word ", ". ", "\n", "\n\n", "\n## t\n", "x" * 30]) for _ in range(rnd.randrange(60)))
        for overlap in (0, 5):
            parts = T.split_chunks(text, 40, overlap)
            assert all(0 < len(p) <= 40 for p in parts)
            if not overlap:
                assert "".join("".join(parts).split()) == "".join(text.split())
    assert T.split_chunks("short", 40, 5) == ["short"] and T.split_chunks("  ", 40, 5) == []


def test_chunks_by_tokens(spark):
    text = "".join(f"word{i} " + ("\n\n" if i % 17 == 0 else "") for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 90)], "doc_id bigint, text string")
    got = {}
    for r in T.chunked_by_tokens(docs, 10, 0).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["content"])
    assert got == {1: T.split_chunks(text, 40, 0), 4: T.split_chunks("x" * 90, 40, 0)}
    assert max(map(len, got[1])) <= 40 and "".join("".join(got[1]).split()) == "".join(text.split())
