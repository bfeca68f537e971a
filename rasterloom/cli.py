"""Command line: ``python -m rasterloom.cli ACTION [NAME] [FOLDER] [OUT]``.

    list                          registered queries and workflow steps
    run NAME FOLDER [OUT]         a query over a table folder or a step over a work folder; OUT is CSV if it ends so, else Parquet
    explain NAME FOLDER           its physical plan
    check                         the static configuration
    prepare | validate | compute | check-grid | pipeline   FOLDER
    persistence-rasters | index-rasters   FOLDER OUT
    fetch-boundary ZONE OUT       outline of a zone by name, as GeoJSON
    fetch-cyano ZONE DATE OUT     one layer of the process service
    check-connection              a token of that service
    download ZONE DATE OUT        a scene's bands by a collection job

The last four need the services' settings in the environment (``RASTERLOOM_*``) and a
confirmation (``--yes``) where more than one scene is meant.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from rasterloom.operators.scenes import InputDataError

LOCAL = ("list", "run", "explain", "check", "prepare", "validate", "compute", "check-grid", "pipeline", "persistence-rasters", "index-rasters")
REMOTE = ("fetch-boundary", "fetch-cyano", "check-connection", "download")


def remote_action(action: str, name: str | None, folder: str | None, out: str | None, send: Callable | None = None, connect: Callable | None = None, confirmed: bool = False) -> str:
    """One action of a remote service; the transport and the client can be injected."""
    from rasterloom import schema as S
    from rasterloom.operators import checks
    from rasterloom.session import session
    from rasterloom.sources import remote, tables

    send = send or remote.http
    known = remote.settings(".env")
    need = lambda k: known.get(f"RASTERLOOM_{k}") or _missing(f"RASTERLOOM_{k}")
    if action == "check-connection":
        remote.token(send, need("TOKEN_URL"), need("CLIENT"), need("SECRET"))
        return "token received"
    if name not in S.ZONES:
        raise InputDataError(f"unknown zone: {name}")
    if action == "fetch-boundary":
        target = folder or _missing("a file")
        west, east, south, north = S.ZONES[name]
        for called in known.get("RASTERLOOM_NAMES", name).split(";"):
            answer = remote.ask_outline(send, need("OUTLINE_URL"), called, (west, east, south, north))
            found = tables.geojson(tables.largest_water(session().createDataFrame([(name, answer)], "lago string, answer string"))).first()
            if found:
                with open(target, "x", encoding="utf-8") as f:
                    f.write(found["geojson"])
                return target
        raise remote.RemoteError(f"no outline for {name}")
    dates = [d for z, d, *_ in S.SCENES if z == name and folder in (None, "all", d)]
    if not dates or not out:
        raise InputDataError(f"no scene of {name} on {folder}, or no target")
    checks.guard_batch(len(dates), confirmed)
    done = []
    for day in dates:
        if action == "download":
            done += remote.download_scene(connect or _missing("a client of collection jobs"), name, day, known.get("RASTERLOOM_BANDS", "B02,B03,B04,B05,B08,B11,B12,SCL").split(","), f"{out}/{name}_{day}")
            continue
        west, east, south, north = S.ZONES[name]
        side = lambda a, b: max(1, min(S.REQUEST_LIMIT, round((b - a) * S.METRES_PER_DEGREE / S.TARGET_M)))
        with open(need("SCRIPT"), encoding="utf-8") as f:
            body = remote.process_body(name, day, f.read(), side(west, east), side(south, north))
        bearer = remote.token(send, need("TOKEN_URL"), need("CLIENT"), need("SECRET"))
        done.append(remote.fetch_layer(send, need("PROCESS_URL"), bearer, body, f"{out}/{name}_{day}_cyano.tif"))
    return "\n".join(done)


def _missing(what: str):
    raise InputDataError(f"{what} is missing")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rasterloom")
    parser.add_argument("action", choices=LOCAL + REMOTE)
    parser.add_argument("name", nargs="?")
    parser.add_argument("folder", nargs="?")
    parser.add_argument("out", nargs="?")
    parser.add_argument("--yes", action="store_true")
    given = parser.parse_args(args)
    from rasterloom.operators import checks
    from rasterloom.plans import workflows
    from rasterloom.plans.tables import QUERIES
    from rasterloom.session import session
    from rasterloom.sources import tables
    from rasterloom.sources.remote import RemoteError

    known = QUERIES | workflows.STEPS
    try:
        if given.action in REMOTE:
            print(remote_action(given.action, given.name, given.folder, given.out, confirmed=given.yes))
        elif given.action == "list":
            print(*known, "compute", sep="\n")
        elif given.action == "check":
            found = checks.configuration()
            if found:
                raise InputDataError(", ".join(found))
        elif given.action in ("run", "explain"):
            if given.name == "compute" and given.folder:
                workflows.run_indices(session(), given.folder)
                return 0
            if given.name not in known or not given.folder:
                raise InputDataError(f"unknown query or no folder: {given.name}")
            df = known[given.name](session(), given.folder)
            if given.action == "explain":
                df.explain("formatted")
            elif given.out and given.out.endswith(".csv"):
                tables.write_csv(df, given.out, "errorifexists")
            elif given.out:
                df.write.mode("errorifexists").parquet(given.out)
            else:
                df.show(20, truncate=False)
        else:
            work = given.name or _missing("a work folder")
            if given.action == "prepare":
                workflows.prepare(session(), work).show(truncate=False)
            elif given.action == "compute":
                workflows.run_indices(session(), work)
            elif given.action == "pipeline":
                print(*workflows.run_all(session(), work), sep="\n")
            elif given.action in ("persistence-rasters", "index-rasters"):
                export = workflows.export_persistence if given.action == "persistence-rasters" else workflows.export_indices
                export(session(), work, given.folder or _missing("a target"))
            else:
                checks.require_none((workflows.validate if given.action == "validate" else workflows.check_grid)(session(), work), given.action)
    except (InputDataError, RemoteError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
