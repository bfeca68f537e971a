"""Clients of remote services, over injected transports.

A transport is a function (url, data, headers, timeout) -> bytes. Nothing here opens a
connection by itself; the driver calls these for a few small requests and files.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence
from urllib.parse import urlencode

from rasterloom import schema as S
from rasterloom.operators.spatial import area

Transport = Callable[[str, bytes, dict[str, str], float], bytes]


class RemoteError(RuntimeError):
    """A service gave no usable answer."""


def http(url: str, data: bytes, headers: dict[str, str], timeout: float) -> bytes:
    """The transport of the command line: one request over HTTP."""
    from urllib.error import URLError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, data or None, headers), timeout=timeout) as answer:  # noqa: S310
            return answer.read()
    except URLError as e:
        raise RemoteError(f"{url}: {e}") from e


def settings(path: str | None = None) -> dict[str, str]:
    """Environment values; those of a settings file only where the environment has none."""
    out = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, sep, value = line.strip().partition("=")
                if sep and not key.startswith("#"):
                    out[key.strip()] = value.strip().strip("\"'")
    return out | dict(os.environ)


def token(send: Transport, url: str, client: str, secret: str, timeout: float = 30) -> str:
    body = urlencode({"grant_type": "client_credentials", "client_id": client, "client_secret": secret}).encode()
    answer = json.loads(send(url, body, {"Content-Type": "application/x-www-form-urlencoded"}, timeout))
    if "access_token" not in answer:
        raise RemoteError("no token")
    return answer["access_token"]


def process_body(zone: str, fecha: str, script: str, width: int, height: int) -> dict:
    """Request of one index layer for a zone and a whole day."""
    west, east, south, north = S.ZONES[zone]
    return {
        "input": {
            "bounds": {"bbox": [west, south, east, north], "properties": {"crs": "http://www.opengis.net/def/crs/EPSG/0/4326"}},
            "data": [{"type": "sentinel-2-l1c", "dataFilter": {"timeRange": {"from": f"{fecha}T00:00:00Z", "to": f"{fecha}T23:59:59Z"}}}],
        },
        "output": {"width": width, "height": height, "responses": [{"identifier": "default", "format": {"type": "image/tiff"}}]},
        "evalscript": script,
    }


def fetch_layer(send: Transport, url: str, bearer: str, body: dict, target: str, timeout: float = 120) -> str:
    """Fetch once: a file that is there already is kept."""
    if os.path.exists(target):
        return target
    raw = send(url, json.dumps(body).encode(), {"Authorization": f"Bearer {bearer}", "Content-Type": "application/json"}, timeout)
    with open(target + ".tmp", "wb") as f:
        f.write(raw)
    os.replace(target + ".tmp", target)
    return target


def outline_query(name: str, box: tuple[float, float, float, float], timeout: int = 90) -> str:
    """Query text for water of a name within (west, east, south, north)."""
    west, east, south, north = box
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    where = f"({south},{west},{north},{east})"
    return f'[out:json][timeout:{timeout}];(way["natural"="water"]["name"="{quoted}"]{where};relation["natural"="water"]["name"="{quoted}"]{where};);out geom;'


def chain(segments: Sequence[Sequence[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings of line segments that share end points; open leftovers are dropped."""
    left = [list(s) for s in segments if len(s) > 1]
    rings = []
    while left:
        ring = left.pop()
        while ring[0] != ring[-1]:
            for k, s in enumerate(left):
                if ring[-1] in (s[0], s[-1]):
                    ring += (s if s[0] == ring[-1] else s[::-1])[1:]
                    del left[k]
                    break
            else:
                break
        if ring[0] == ring[-1] and len(ring) >= 4:
            rings.append(ring)
    return rings


def cleaned(ring: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """A closed ring without repeated points and without spikes (ways out and back); empty if nothing is left."""
    points = list(ring[:-1]) if ring and ring[0] == ring[-1] else list(ring)
    changed = True
    while changed and len(points) > 2:
        changed = False
        for k in range(len(points)):
            before, here, after = points[k - 1], points[k], points[(k + 1) % len(points)]
            if here == before or before == after:
                del points[k]
                changed = True
                break
    return [*points, points[0]] if len(points) > 2 else []


def rings_of(element: dict) -> list[list[tuple[float, float]]] | None:
    """Outer ring first, then holes, of a way or a relation; None if it encloses nothing."""
    points = lambda g: [(p["lon"], p["lat"]) for p in g]
    if element.get("type") == "way":
        ring = points(element.get("geometry", []))
        rings = [ring] if len(ring) >= 4 and ring[0] == ring[-1] else []
    else:
        parts = {r: chain([points(m["geometry"]) for m in element.get("members", []) if m.get("role") == r and m.get("geometry")]) for r in ("outer", "inner")}
        rings = [*sorted(parts["outer"], key=lambda r: -area([r])), *parts["inner"]]
    rings = [r for r in map(cleaned, rings) if r]
    return rings if rings and area(rings[:1]) > 0 else None


def ask_outline(send: Transport, url: str, name: str, box: tuple[float, float, float, float], timeout: float = 90) -> str:
    """The service's answer for one name, as text; ``tables.largest_water`` makes polygons of it."""
    return send(url, outline_query(name, box).encode(), {}, timeout).decode()


def fetch_outline(send: Transport, url: str, names: Sequence[str], box: tuple[float, float, float, float], timeout: float = 90) -> list[list[tuple[float, float]]]:
    """Largest outline of the first name that has one."""
    for name in names:
        answer = json.loads(send(url, outline_query(name, box).encode(), {}, timeout))
        found = [r for e in answer.get("elements", []) if (r := rings_of(e))]
        if found:
            return max(found, key=area)
    raise RemoteError(f"no outline for {list(names)}")


def inspect_collection(connect: Callable[[], object], wanted: Sequence[str]) -> dict[str, list[str]]:
    """Bands that a collection offers, and those of the wanted ones that it lacks."""
    offered = sorted(connect().bands())
    return {"ofrecidas": offered, "faltan": sorted(set(wanted) - set(offered))}


def download_scene(connect: Callable[[], object], zone: str, fecha: str, bands: Sequence[str], folder: str) -> list[str]:
    """Run a collection job of an injected client into a folder that must not hold files yet."""
    if os.path.isdir(folder) and os.listdir(folder):
        raise FileExistsError(folder)
    client = connect()
    missing = set(bands) - set(client.bands())
    if missing:
        raise RemoteError(f"bands not offered: {sorted(missing)}")
    os.makedirs(folder, exist_ok=True)
    west, east, south, north = S.ZONES[zone]
    return list(client.download({"west": west, "south": south, "east": east, "north": north}, fecha, list(bands), folder))
