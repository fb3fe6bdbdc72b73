import json

import pytest

from tidewheel.plans import registry

ENTRIES = [
    {"id": "droid", "name": "DROID", "description": "many kitchens", "format": "rlds", "embodiment": ["franka"], "tags": ["large", "kitchen"], "demo_suitable": False, "sources": [{"type": "hub", "uri": "hf://org/droid"}]},
    {"id": "pusht", "name": "PushT", "description": "a kitchen toy", "format": "lerobot-v3", "embodiment": ["xarm"], "tags": ["sim"], "demo_suitable": True, "sources": []},
]


def test_registry(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(ENTRIES))
    r = registry.Registry(spark, f"file://{tmp_path}/d.json")
    ids = lambda df: [x["id"] for x in df.collect()]
    assert r.get("droid")["name"] == "DROID" and ids(r.list(format="LEROBOT")) == ["pusht"] and ids(r.list(embodiment="frank")) == ["droid"]
    assert ids(r.list(tag="kitch")) == ["droid"] and ids(r.list(demo_only=True)) == ["pusht"] and ids(r.list(tag="sim", format="rlds")) == []
    assert ids(r.search("kitchen")) == ["droid", "pusht"] and ids(r.search("kitchen toy")) == ["pusht"] and ids(r.search("nothing")) == []
    with pytest.raises(KeyError, match="did you mean droid"):
        r.get("droi")
    for wrong, place in (({"name": "x", "format": "y"}, r"datasets\[0\].id"), ({"id": "A b", "name": "x", "format": "y"}, r"datasets\[0\].id"), ({"id": "a", "name": "x", "format": "y", "tags": "t"}, r"datasets\[0\].tags")):
        (tmp_path / "w.json").write_text(json.dumps([wrong]))
        with pytest.raises(ValueError, match=place):
            registry.Registry(spark, f"file://{tmp_path}/w.json")
    where = lambda n: registry.resolve_path(spark, n, r)
    assert where("hf://a/b:c@d")[0] == "hub" and where("s3://x/y") == ("store", "s3://x/y") and where(f"{tmp_path}") == ("path", f"{tmp_path}")
    assert where("droid") == ("hub", "hf://org/droid") and where("org/repo") == ("hub", "hf://org/repo") and where("/no/such") == ("path", "/no/such")
    with pytest.raises(ValueError, match="no source"):
        where("pusht")


def test_selection_files(spark, tmp_path):
    path = f"file://{tmp_path}/s.json"
    registry.write_selection(spark, path, ["b", "a", "b"], "studio", "good", "approved")
    registry.write_selection(spark, path, ["b", "a", "b"], "studio", "good", "approved")
    assert registry.read_selection(spark, path) == {"episode_ids": ["b", "a"], "source": "studio", "reason": "good", "label": "approved"}
    (tmp_path / "w.json").write_text('{"episode_ids": [1]}')
    with pytest.raises(ValueError, match="episode_ids"):
        registry.read_selection(spark, f"file://{tmp_path}/w.json")
