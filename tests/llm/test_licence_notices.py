import pytest

from docengine.llm import licences

WRAPPED = {
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at",
}


def families(text):
    return {h[0] for h in licences.classifier().scan(text)} - {licences.UNKNOWN}


@pytest.mark.parametrize("family", sorted(WRAPPED))
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n# ", "\n * "])
def test_wrapped_notices(family, end):
    assert family in families("Copyright 2020 Someone\n\n" + WRAPPED[family].replace("\n", end) + "\n\nplain words")


def test_paragraphs_stay_apart():
    both = WRAPPED["BSD"] + "\n \t\n" + WRAPPED["MIT"]
    assert [h[0] for h in licences.classifier().scan(both)] == ["BSD", "MIT"]


def declared(spark, text):
    row = licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    return row.n_paragraphs, row.families


def test_all_families_of_a_paragraph(spark):
    mit, apache, gpl2, gpl3 = (licences.TEMPLATES[f][0] for f in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0"))
    assert declared(spark, f"{mit} {apache}") == (1, "Apache-2.0,MIT")
    assert declared(spark, f"{gpl2} {gpl3}") == (1, "GPL-2.0,GPL-3.0")
    far = " word" * 150
    assert declared(spark, f"{mit}{far} {apache}{far} {gpl3}\n\n{mit}") == (2, "Apache-2.0,GPL-3.0,MIT")
    five = [licences.TEMPLATES[f][0] for f in ("MIT", "ISC", "CC0", "BSD", "MPL-2.0")]
    assert declared(spark, " ".join(five)) == (1, "BSD,CC0,ISC,MIT,MPL-2.0")


def test_no_relatives_beside_a_family():
    for family, texts in licences.TEMPLATES.items():
        for text in texts:
            assert families(text) == {family}, text


@pytest.mark.parametrize("family", sorted(WRAPPED))
def test_notices_anywhere_in_a_paragraph(family):
    for n in range(0, 80, 7):
        assert families("word " * n + WRAPPED[family] + " word" * n) == {family}, n
