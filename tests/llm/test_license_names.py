"""Licenses that share most of their words are told apart, or not named at all."""

from __future__ import annotations

import pytest

from factloom.llm import license as lic

BSD = """Copyright (c) 2011, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """3. Neither the name of the holder nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission.
"""
GNU = """This {thing} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{comma} either version {version} of the License, or
(at your option) any later version."""


def gnu(version, kind="", thing="program", old=False):
    return GNU.format(version=version, kind=kind, thing=thing, mark=";" if old else ":", comma=";" if old else ",")


TEXTS = {
    "gpl2": (gnu("2", old=True), "GPL-2.0"), "gpl3": (gnu("3"), "GPL-3.0"), "gpl3 named": (gnu("3", thing="file"), "GPL-3.0"), "lgpl2": (gnu("2.1", "Lesser ", "library", True), "LGPL-2.1"),
    "lgpl3": (gnu("3", "Lesser ", "library"), "LGPL-3.0"), "agpl": (gnu("3", "Affero "), "AGPL-3.0"), "bsd2": (BSD, "BSD-2-Clause"), "bsd3": (BSD + THIRD, "BSD-3-Clause"),
    "isc": ("Copyright 2010 Some Body\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED", "ISC"),
    "unlicense": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", "Unlicense"),
    "mit": ("Copyright (c) 2010 Some Body. All rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights", "MIT"),
    "apache": ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at", "Apache-2.0"),
    "reserved": ("Copyright 2010 Some Body. All rights reserved.\nAll rights reserved.", "Proprietary"),
    "no version": ("This work is licensed under the GNU General Public License", None), "no clause": (lic.TEMPLATES["BSD-2-Clause"][2], None), "gpl file": ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"),
    "lgpl file": ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "LGPL-2.1"), "agpl file": ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"), "gpl3 file": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"),
    "by": ("Licensed under CC BY 4.0", "CC-BY-4.0"), "by-sa": ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
}
#: Prose about other things, so that words have the weights they have in a corpus.
OTHER = [f"Some plain text {i} about this and that, with the words of any work, copy or version 2 or 3 of it under way, by {i} people." for i in range(300)]


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_standard_texts(spark, prefix):
    rows = [(name, f"src/of_{name}.py", "import this\n" + "\n".join(prefix + x for x in text.split("\n")) + "\nother code") for name, (text, _) in TEXTS.items()]
    out = lic.scan(spark.createDataFrame(rows + [(str(i), f"doc/{i}", t) for i, t in enumerate(OTHER)], "name string, path string, text string")).collect()
    assert {r.name: r.license for r in out if r.name in TEXTS} == {name: want for name, (_, want) in TEXTS.items()}
    assert all(r.license is None for r in out if r.name not in TEXTS)


def test_every_template_names_its_license(spark):
    rows = [(name, line) for name, group in lic.TEMPLATES.items() for line in group]
    out = lic.scan(spark.createDataFrame([(n, f"a/{i}.c", t) for i, (n, t) in enumerate(rows)] + [("none", "b", t) for t in OTHER], "name string, path string, text string")).collect()
    got = sorted((r.name, r.text, r.license) for r in out if r.name != "none" and not r.text.startswith("Redistribution"))
    assert got == sorted((n, t, n) for n, t in rows if not t.startswith("Redistribution"))
    assert set(lic.TELLS) == set(lic.TEMPLATES)
