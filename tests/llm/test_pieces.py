"""Ids, spans and the character map against the library."""

import sentencepiece

from newsgraph.llm import pieces, queries

TEXTS = ["Hello  world", " lead", "trail ", "é ñ ß 日本 \U0001f600", "tab\tnew\nline", "▁ already", "a", " ", "​\u0001", "x" * 500 + " y" * 20_000]


def test_ids_and_spans(spark, make_docs):
    path = queries.model_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*enumerate(TEXTS), (50, None), (51, ""), (0, "Hello  world"), (None, "null key")]
    found = pieces.encode(make_docs(rows, clash=["ids", "decoded"]), path, ["doc_id", "text", "ids"]).collect()
    assert len(found) == len(rows)
    for r in found:
        text = r.text or ""
        ids = model.encode(text)
        assert r.ids == ids and r.decoded == (model.decode(ids) if ids else "")
        data = text.encode()
        assert b"".join(data[s:e] for s, e in zip(r.starts, r.ends)) == data
        assert all(a == b for a, b in zip(r.ends, r.starts[1:]))
        for i, s, e in zip(ids, r.starts, r.ends):
            if not model.is_byte(i):
                piece = model.id_to_piece(i)
                plain = data[s:e].decode().replace(" ", "▁")
                assert plain == piece or (s == 0 and "▁" + plain == piece)
    assert pieces.encode(make_docs(rows).limit(0), path, ["doc_id"]).count() == 0


def test_character_map_equals_the_library():
    for rule in ("nfkc", "nmt_nfkc", "nmt_nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(library.serialized_model_proto())
        e = pieces.Encoder.__new__(pieces.Encoder)
        e.spec, e.suffix = proto.normalizer_spec, False
        e.map = pieces.CharacterMap(e.spec.precompiled_charsmap)
        assert len(e.map.rules) > 1000
        for text in ["Ｈｅｌｌｏ　ｗｏｒｌｄ", "ﬁne ½ Å é ①", "plain text", "한국 ㌖ ｶﾞ", "áé", "  two  spaces ", "x​y\tz", "日本ｶﾞ語"]:
            want, offsets = library.normalize(text, with_offsets=True)
            got, source = e.normalise(text.encode())
            assert got.decode() == want
            if not e.spec.escape_whitespaces:
                at = [len(text.encode()[:s].decode()) for s in (source[len(got.decode()[:i].encode())] for i in range(len(want)))]
                assert at == list(offsets)[: len(want)]
