"""Downloads on the driver: retries with growing pauses, and fetching by id (IO1, IO2). The transport is a function, so no network is needed here."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from pathlib import Path

#: Seconds of the first pause after a busy server and after a broken connection; each further pause doubles.
BUSY_PAUSE, BROKEN_PAUSE, TRIES = 5.0, 3.0, 4

Get = Callable[[str], tuple[int, bytes]]


def fetch(url: str, get: Get, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """The body at ``url``; None if the server refuses it or stays busy or out of reach.

    ``get(url)`` gives a status and a body, or raises ``ConnectionError``. 429 and 5xx are tried again, any other failure is not.
    """
    for n in range(tries):
        try:
            status, body = get(url)
        except ConnectionError:
            pause = BROKEN_PAUSE
        else:
            if status == 200:
                return body
            if status != 429 and status < 500:
                return None
            pause = BUSY_PAUSE
        if n + 1 < tries:
            sleep(pause * 2**n)
    return None


def download(
    ids: Iterable[str], locate: Callable[[str], str | None], direct: Callable[[str], str], get: Get, folder: str, pause: float = 1.5,
    sleep: Callable[[float], None] = time.sleep,
) -> list[dict]:
    """Fetch each id into ``folder``; one record per id: ``id``, ``url``, ``path`` (None where it could not be had).

    ``locate(id)`` looks the address up; where it gives None or fails, ``direct(id)`` is taken. Slashes in ids become underscores in names.
    """
    out = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for n, one in enumerate(ids):
        if n:
            sleep(pause)
        try:
            url = locate(one) or direct(one)
        except Exception:  # the lookup service is a convenience
            url = direct(one)
        body = fetch(url, get, sleep=sleep)
        path = None if body is None else Path(folder) / f"{one.replace('/', '_')}.pdf"
        if path is not None:
            path.write_bytes(body)
        out.append({"id": one, "url": url, "path": None if path is None else str(path)})
    return out
