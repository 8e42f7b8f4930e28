"""Licence notices that are wrapped over several lines."""

import textwrap

import pytest

from weirflow.llm.licenses import licence_paragraphs

PROSE = "The river rose over night and by the morning the lower meadows stood under water, so that the farmers had to bring their sheep up to the hills. "
NOTICES = {
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "CC0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
}


def found(spark, texts):
    rows = licence_paragraphs(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).where("confirmed").collect()
    return sorted((r.doc_id, r.family) for r in rows)


@pytest.mark.parametrize("width", [40, 76])
def test_wrapped_notices(spark, width):
    texts = {k: "\n".join(textwrap.wrap(v, width if k != "CC0" else 34)) for k, v in NOTICES.items()}
    assert found(spark, texts) == [(k, k) for k in sorted(NOTICES)]
    commented = {k: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */" for k, t in texts.items()}
    assert found(spark, commented) == [(k, k) for k in sorted(NOTICES)]


def test_wrapped_notices_inside_prose(spark):
    texts = {k: "\n".join(textwrap.wrap(PROSE * 3, 76) + [""] + textwrap.wrap(v, 76 if k != "CC0" else 34) + [""] + textwrap.wrap(PROSE * 3, 76)) for k, v in NOTICES.items()}
    assert found(spark, texts) == [(k, k) for k in sorted(NOTICES)]


def test_a_notice_in_one_line_is_reported_once(spark):
    texts = {"a": PROSE + "\nReleased under the MIT License.\n" + PROSE, "b": PROSE + "\n" + PROSE}
    assert found(spark, texts) == [("a", "MIT")]
