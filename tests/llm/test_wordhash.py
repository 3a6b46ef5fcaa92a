from lorewright.llm import wordhash



def test_word_hashes():
    import re
    import unicodedata

    texts = ["Ünï CODE ﬁn 1½x", None, "", "soft­hyphen zero​width", "漢字 kana", "a_b c-d"]
    o, h = wordhash.word_hashes(texts)
    cf = {i: None for i in range(0x11000) if unicodedata.category(chr(i)) == "Cf"}
    ws = [re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t or "").translate(cf).lower()) for t in texts]
    assert [int(b - a) for a, b in zip(o, o[1:])] == [len(w) for w in ws]
    seen = {}
    for w, x in zip([w for ws_ in ws for w in ws_], h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert (wordhash.word_hashes(texts, part=3)[1] == h).all()
