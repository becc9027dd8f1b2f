"""Downloads with a transport that is played."""

from corpusloom.sources.fetch import download, fetch


def played(*answers):
    left = list(answers)

    def get(url):
        now = left.pop(0)
        if isinstance(now, Exception):
            raise now
        return now

    return get


def test_busy_servers_and_broken_connections_are_tried_again():
    pauses = []
    assert fetch("u", played((429, b""), ConnectionError(), (503, b""), (200, b"x")), sleep=pauses.append) == b"x"
    assert pauses == [5.0, 6.0, 20.0]
    assert fetch("u", played((404, b"")), sleep=pauses.append) is None and len(pauses) == 3
    assert fetch("u", played(*[(500, b"")] * 4), sleep=pauses.append) is None and pauses[3:] == [5.0, 10.0, 20.0]


def test_ids_fall_back_to_the_direct_address(tmp_path):
    asked = []

    def get(url):
        asked.append(url)
        return (200, url.encode()) if "gone" not in url else (404, b"")

    def locate(one):
        if one == "b":
            raise RuntimeError("no service")
        return None if one == "gone" else f"meta/{one}"

    got = download(["a/1", "b", "gone"], locate, lambda one: f"direct/{one}", get, str(tmp_path), sleep=lambda s: None)
    assert asked == ["meta/a/1", "direct/b", "direct/gone"]
    assert [r["path"] and r["path"].rsplit("/", 1)[1] for r in got] == ["a_1.pdf", "b.pdf", None]
    assert (tmp_path / "a_1.pdf").read_bytes() == b"meta/a/1"
