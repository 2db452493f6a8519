"""Licence tags with other text on their line."""

import pytest

from scorelake.llm import licenses

SCANNER = licenses.Scanner(licenses.BASE_PHRASES, licenses.NOTICES, licenses.TAGS)


@pytest.mark.parametrize("line, expression, labels, broken", [
    ("<!-- SPDX-License-Identifier: MIT -->", "MIT", "mit", False),
    ("// SPDX-License-Identifier: MIT - see LICENSE", "MIT", "mit", False),
    ("SPDX-License-Identifier: GPL-2.0-only and more prose follows", "GPL-2.0-only", "gpl", True),
    ("SPDX-License-Identifier: MIT. All rights reserved", "MIT", "mit,proprietary", False),
    ("SPDX-License-Identifier: MIT/Apache-2.0", "MIT/Apache-2.0", "apache,mit", False),
    ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception.", "Apache-2.0 WITH LLVM-exception", "apache", False),
    ("/* SPDX-License-Identifier: (MIT OR GPL-2.0+) AND CC0-1.0 */", "(MIT OR GPL-2.0+) AND CC0-1.0", "cc0,gpl,mit", False),
    ("SPDX-License-Identifier: mit or", "mit", "mit", True),
    ("SPDX-License-Identifier: LicenseRef-Own_1", "LicenseRef-Own_1", "licenseref-own_1", False),
    ("SPDX-License-Identifier: MIT (see file)", "MIT", "mit", False)])
def test_leading_expression(line, expression, labels, broken):
    *_, found, _, expressions, malformed, _ = SCANNER.scan(line.encode())
    assert expressions[0] == expression and set(found.split(",")) == set(labels.split(",")) and bool(malformed) == broken


@pytest.mark.parametrize("line", ["SPDX-License-Identifier: (MIT", "SPDX-License-Identifier: see the file", "SPDX-License-Identifier: or MIT",
                                  "SPDX-License-Identifier: --"])
def test_nothing_to_read(line):
    *_, labels, score, expressions, malformed, _ = SCANNER.scan(line.encode())
    assert (labels, score, expressions) == ("", 0.0, []) and len(malformed) == 1


def test_long_lines_are_read_once():
    line = b"SPDX-License-Identifier: " + b" OR ".join([b"MIT"] * 50_000) + b" (" * 50_000
    *_, labels, _, expressions, malformed, _ = SCANNER.scan(line)
    assert labels == "mit" and not malformed and expressions[0].count("MIT") == 50_000
