"""Whole licence files, wrapped notices and notices within long lines."""

import pytest

pytest.importorskip("ledgerline.llm.registry")
from ledgerline.llm import license_scan  # noqa: E402
from ledgerline.llm.license_texts import TEXTS  # noqa: E402


def test_whole_and_wrapped_licenses(spark):
    code = " ".join(f"name{i} = value{i} of the code in this file" for i in range(80))
    rows = [(1, "r/LICENSE", None), (2, "r/src/x.py", code)]
    for i, (name, text) in enumerate(sorted(TEXTS.items())):
        rows += [(10 + 2 * i, f"{name}/LICENSE", "Copyright (c) 2024 Some Person\n\n" + text), (11 + 2 * i, f"{name}/a/b.py", f"{code} {i}")]
    rows += [
        (50, "w/COPYING", "Licensed under the Apache License,\nVersion 2.0 (the \"License\"); you may not\nuse this file except in compliance with the License."), (51, "w/y.py", code + " w"),
        (52, "l/z.py", f"{code} This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License {code}"), (53, "l/y.py", code + " l"),
        (54, "m/z.py", f"{code}\nwith words before  Released under the\nMIT License. {code}"), (None, "o/z.py", ""),
    ]
    rows += [(100 + i, f"s/f{i}", f"plain words {i} the of and to under this file") for i in range(60)]
    got = {r["path"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert len(got) == len(rows)
    for name in TEXTS:
        own, below = got[f"{name}/LICENSE"], got[f"{name}/a/b.py"]
        assert own["license"] == name and own["score"] >= 0.8
        assert (below["license"], below["inherited"], below["inherited_from"]) == (None, name, name)
    assert got["w/COPYING"]["license"] == "Apache-2.0" and got["w/y.py"]["inherited"] == "Apache-2.0"
    assert got["l/z.py"]["license"] == "GPL-3.0" and got["l/y.py"]["inherited"] is None
    assert (got["m/z.py"]["license"], got["m/z.py"]["line"]) == ("MIT", 1)
    assert got["r/src/x.py"]["license"] is None and got["r/src/x.py"]["inherited"] is None
    assert all(got[f"s/f{i}"]["license"] is None for i in range(60))
