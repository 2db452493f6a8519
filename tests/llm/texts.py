"""Texts with every odd case."""

LONG = "a" * 3000 + " " + "xyzzy " * 400 + "1" * 500 + " é" * 50
TEXTS = [
    (1, None), (2, ""), (3, " \n \n\t "), (4, LONG), (5, "Same text, same row. MIT License"), (5, "Same text, same row. MIT License"),
    (6, "Same text, same row. MIT License"), (None, "a row without an id under the GNU General Public License"),
    (8, "mail a@b.c_d@e.f or x.y@mail.example.com, ip 1.2.3.4.5 300.1.1.1 0001.2.3.4, card 4111 1111 1111 1111 and 4111-1111-1111-1112"),
    (9, "+49 (30) 123456-78 and +1((( +1+2 +12345678 é\U0001f600 x@y.zz call +1 555 123 4567"),
    (10, "a  b   c\n\n d \n e x　 　y  don't  '  's \x1c z"), (11, "one two three four five six seven eight nine ten eleven"),
    (12, "ONE two three four five six seven eight nine TEN"), (13, "Hello World"), (14, "hello world hello, world"),
    (15, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only WITH Classpath-exception-2.0\nx"),
    (16, 'SPDX-License-Identifier: MIT OR\npassword = "abcdefgh12345678ABCD" Mr. John Smith'), (17, "CC BY-NC 4.0 and mit license mit license"),
    (18, "dup line\ndup line\nother\n#*$ | <>"), (19, "w " * 200), (20, "\n".join(f"line {k} of the text" for k in range(40))),
]
