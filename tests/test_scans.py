import hashlib

from sonograin.operators import coverage, evidence


def test_files_of_the_family_are_opened_once_and_others_not_at_all(spark, tmp_path):
    deep = tmp_path / "in" / "deep"
    deep.mkdir(parents=True)
    texts = {
        "in/Streaming_History_Audio_2024_1.json": b'[{"ts":"2024-01-02T03:04:05Z"},7]', "in/deep/Streaming_History_Audio_2023-2024_12.json": b"[]",
        "in/Streaming_History_Video_2024_1.json": b"[1]", "in/Streaming_History_Audio_24_1.json": b"[2]", "in/Streaming_History_Audio_2024_1.json.bak": b"[3]", "in/deep/notes.json": b"[4]",
        "in/deep/Streaming_History_Audio_2024_2.json": b'["\xff"]', "inner_Streaming_History_Audio_2024_1.json": b"[5]",
    }
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content)
    root = f"file:{tmp_path}/in"
    found = evidence.scanned_files(spark, [root, f"{root}/deep", f"{root}/", root])
    got = {r.name: (r.byte_size, r.content_sha256, r.value) for r in found.collect()}
    want = [n for n in texts if n.startswith("in/") and n.rsplit("/")[-1] in ("Streaming_History_Audio_2024_1.json", "Streaming_History_Audio_2023-2024_12.json", "Streaming_History_Audio_2024_2.json")]
    assert found.count() == 3 and got == {n.rsplit("/")[-1]: (len(texts[n]), hashlib.sha256(texts[n]).hexdigest(), texts[n].decode(errors="replace")) for n in want}
    members = evidence.json_members(found, carry=("name", "content_sha256"))
    assert sorted((r.name, r.ordinal) for r in members.collect()) == [("Streaming_History_Audio_2024_1.json", 0), ("Streaming_History_Audio_2024_1.json", 1), ("Streaming_History_Audio_2024_2.json", 0)]
    ranges = coverage.observed_ranges(spark.createDataFrame([("a", 3), ("a", 1), ("b", None)], "name string, at long"), "at", "name")
    assert {(r.name, r.first_ms, r.last_ms, r.n) for r in ranges.collect()} == {("a", 1, 3, 2), ("b", None, None, 1)}
