"""Licence rules on true notices and on sentences that only sound like them."""

import pytest

from quillspark.llm import licences
from quillspark.llm.licence_passages import PASSAGES

SCANNER = licences.Scanner()

TRUE = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute", "mit"),
    ("Licensed under the MIT License.", "mit"), ("This project is released under the MIT licence", "mit"),
    ("SPDX-License-Identifier: MIT", "mit"), ("MIT-style license", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");", "apache-2.0"),
    ("you may not use this file except in compliance with the License.", "apache-2.0"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "apache"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "bsd"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement", "bsd-4-clause"),
    ("simplified BSD license", "bsd-2-clause"), ("Released under the BSD license", "bsd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3.0"),
    ("GNU General Public License, version 2", "gpl-2"), ("GPLv3 or later", "gpl-3"),
    ("free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("WITHOUT ANY WARRANTY; distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of", "gpl"),
    ("Free Software Foundation, Inc., 51 Franklin Street", "gpl"), ("GNU Affero General Public License version 3", "agpl-3"),
    ("under the terms of the GNU Free Documentation License", "gfdl"), ("with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts", "gfdl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("Eclipse Public License v1.0 which accompanies this distribution", "epl-1.0"),
    ("subject to the terms of the Common Development and Distribution License", "cddl"),
    ("modify it under the same terms as Perl itself", "artistic"), ("This Font Software is licensed under the SIL Open Font License, Version 1.1", "ofl"),
    ("Boost Software License - Version 1.0", "boost-1.0"),
    ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software", "zlib"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "wtfpl"), ("you can buy me a beer in return", "beerware"),
    ("The Software shall be used for Good, not Evil.", "json"), ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("CC BY-SA 3.0", "cc-by-sa-3.0"), ("CC BY-NC-ND 4.0", "cc-by-nc-nd-4.0"), ("CC0 1.0 Universal", "cc0"),
    ("This file is in the public domain", "public-domain"), ("Open Database License", "odbl"),
    ("Business Source License 1.1", "busl-1.1"), ("Server Side Public License", "sspl"), ("All rights reserved.", "reserved"),
    ("Alle Rechte vorbehalten", "reserved"), ("End User License Agreement", "proprietary"),
    ("No part of this publication may be reproduced", "reserved"), ("Copyright (c) 2019", "copyright"),
]

HARMLESS = [
    "Students working under MIT faculty publish often", "A course was held at MIT in the spring", "written under Apache rule in the valley",
    "The Apache helicopter landed", "the chief of the Apache people spoke", "Boost your sales this winter", "an elastic band snapped",
    "the eclipse was public and free", "He got his driving license renewed", "a license to kill", "the fishing licence costs ten pounds",
    "Permission is required to enter the building", "permission was granted by the mayor", "free of charge for children under six",
    "the software was sold to a competitor", "without any doubt the best soup", "Ruby wore a red dress", "a python escaped from the zoo",
    "the vim and vigour of youth", "curl your hair at home", "the general public was invited to the opening", "a public hearing on the new road",
    "the library is open to the general public", "he was general manager of a public company", "common development goals were agreed",
    "distribution of food in the north", "redistribution of wealth was debated", "binary stars orbit each other", "The artistic director resigned",
    "the creative class and the commons", "the commons debated the bill", "a zero interest loan", "attribution of the painting is disputed",
    "Mozilla was mentioned in the news", "The postgres conference was fun", "the gnu grazes in Kenya", "a herd of gnu crossed the river",
    "released under pressure from the press", "published under a false name", "distributed under the table", "available under the counter",
    "covered under the insurance", "He reserved all seats in the front", "some rights of way were closed", "the rights of the people are reserved to them",
    "an unauthorized biography appeared", "the proprietor was confidential about it", "Domain names are public", "the public bought shares of the domain",
    "the psf of the telescope was narrow", "isc results come out in May", "the expat community in Lisbon",
]


@pytest.mark.parametrize("text,label", TRUE)
def test_true_notices(text, label):
    assert label in SCANNER.scan(text.encode())[5].split(",")


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless_sentences(text):
    assert SCANNER.scan(text.encode())[5] == ""


def test_passages_are_rules_of_their_own():
    assert len(HARMLESS) >= 50 and len(TRUE) >= 50 and len(PASSAGES) >= 130
    assert len({pattern for *_, pattern in PASSAGES}) == len(PASSAGES)
    for *_, keywords, pattern in PASSAGES:
        assert keywords and all(k == k.lower() for k in keywords)
