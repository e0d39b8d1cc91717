"""Licence texts and notices as templates: label and wording.

``[`` and ``]`` enclose what may be left out, ``<a|b>`` what may be either, and ``<name:n>`` what may be replaced by up to n
words. They may be nested. All else is wording that must stand as it is; only its words count, not case or marks.
"""

from __future__ import annotations

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."""

_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: [1.] Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. [2.] Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""

# The wording of licences and of the notices that name them.
TEMPLATES: list[tuple[str, str]] = [
    ("mit-notice", "<licensed|released|distributed|available|published> under the [terms of the] MIT [expat] license"),
    ("mit-text", _MIT_GRANT.replace("(including the next paragraph)", "[(including the next paragraph)]")),
    ("apache-2.0-notice", "<licensed|released|distributed|available|published> under the [terms of the] Apache license [,] [version] 2.0"),
    ("apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <thing:2> except in
compliance with the License. You may obtain a copy of the License at <place:12> Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-notice", "<licensed|released|distributed|available|published> under the [terms of the] GNU [<lesser|affero>] general public license [[as published by the free software foundation] [,] [either] version <2|2.0|2.1|3|3.0>] [of the license] [or [at your option] any later version]"),
    ("gpl-header", """This program is free software[:] you can redistribute it and/or modify it under the terms of the GNU [<lesser|affero>] General
Public License as published by the Free Software Foundation[,] [either] version <2|2.1|3> of the License [, or (at your option) any
later version]."""),
    ("cc-notice", "<licensed|released|distributed|available|published> under [<a|the>] [terms of the] <CC|Creative Commons> <BY|Attribution> [<NC|NonCommercial|Non Commercial>] [<SA|ShareAlike|Share Alike|ND|NoDerivatives>] <1.0|2.0|2.5|3.0|4.0> [international] [license]"),
    ("bsd-2-clause-text", _BSD_TERMS + " THIS SOFTWARE IS PROVIDED BY <holder:12> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("bsd-3-clause-text", _BSD_TERMS + """ [3.] Neither the name of <holder:12> nor the names of <whose:2> contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""),
    ("isc-text", """Permission to use, copy, modify, and[/or] distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl-2.0-notice", "This source code form is subject to the terms of the Mozilla Public License [,] v. 2.0."),
    ("unlicense-text", "This is free and unencumbered software released into the public domain."),
]
