"""The command line, end to end over a file."""

import json
import uuid

from shoal import cli
from shoal.sources.tables import shared_dir


def test_import_and_read(spark, tmp_path, capsys):
    f = tmp_path / "in.ndjson"
    trucks = [("t1", -46.63, -23.55), ("t2", -46.64, -23.56), ("t3", -46.62, -23.54), ("t4", -43.17, -22.9)]
    lines = [json.dumps({"id": i, "lng": x, "lat": y, "cat": "idle"}) for i, x, y in trucks]
    f.write_text("\n".join([*lines, json.dumps({"id": "t4", "lng": -43.2, "lat": -22.95, "props": {"n": 1}}), '{"id":"bad","lng":1,"lat":2,"oops":1}']) + "\n")
    at = ["--path", f"{shared_dir(spark)}/cli-{uuid.uuid4().hex}", "--collection", "fleet", "--json"]

    def call(*args):
        code = cli.main([*args, *at])
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert call("import", "--file", f"file://{f}", "--categories", "idle,enroute", "--no-create")[0] == 1
    assert call("import", "--file", f"file://{f}", "--categories", "idle,enroute") == (0, [{"devices": 4, "refused": 1}])
    assert call("create", "--categories", "idle,enroute") == (0, [{"collection": "fleet", "created": False}])
    assert call("create", "--radius", "99")[0] == 1
    assert call("report", "--id", "t9", "--lng", "1", "--lat", "2", "--props", '{"k":2}', "--cat", "enroute") == (0, [{"devices": 1, "refused": 0}])
    assert call("report", "--id", "t9", "--lng", "1", "--lat", "2", "--cat", "no") == (0, [{"devices": 0, "refused": 1}])
    assert call("get", "--id", "t9")[1][0]["num"] == 4
    assert call("rm", "--id", "t9")[0] == 0 and call("rm", "--id", "t9")[0] == 1
    (row,) = call("stats")[1]
    assert row["devices"] == 4 and row["snapshot_bytes"] > 0
    assert call("watch", "--times", "2", "--every", "0")[1] == [{"status": "ok", "collections": 1, "devices": 4}] * 2
    assert call("tile", "--tile", "0/0/0")[1][0]["bytes"] > 0 and call("tile", "--tile", "1/5/0")[0] == 1
    assert len(json.loads(call("tile", "--tile", "0/0/0.json")[1][0]["features"])) >= 1
    assert call("snapshot", "--to", f"{shared_dir(spark)}/copy-{uuid.uuid4().hex}")[1][0]["devices"] == 4
    assert call("collections")[1] == [{"collection": "fleet", "devices": 4}]
    assert sum(r["count"] for r in call("clusters", "--zoom", "4")[1]) == 4
    assert call("has", "--id", "nobody")[1] == [{"id": "nobody", "live": False}]
    assert call("get", "--id", "nobody")[0] == 1 and call("get", "--id", "t4")[1][0]["props"] == '{"n":1}'
    assert call("clusters", "--cat", "nope")[0] == 1
    assert all(r["violations"] == 0 for r in call("verify")[1])
    big = next(r for r in call("clusters", "--zoom", "3")[1] if r["is_cluster"])
    assert len(call("leaves", "--cluster", str(big["cluster_id"]))[1]) == big["count"]
    assert call("seed", "--limit", "30")[1] == [{"devices": 30}] and call("collections")[1] == [{"collection": "fleet", "devices": 34}]
    assert call("drop")[0] == 0 and call("drop")[0] == 1
