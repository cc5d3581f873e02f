"""Templates of licence statements: names, identifiers, and sentences of licence texts and their notices."""

from __future__ import annotations

#: Public licences as (identifier, name, a term without which a name or identifier is another licence's).
NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License, version 3", "affero"),
    ("Apache-2.0", "Apache License, Version 2.0", "apache"),
    ("BSD-2-Clause", "BSD 2-Clause Simplified License", "bsd"),
    ("BSD-3-Clause", "BSD 3-Clause License", "bsd"),
    ("BSL-1.0", "Boost Software License, Version 1.0", "boost"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License, CC BY 4.0", "creative"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "noncommercial"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "sharealike"),
    ("CC0-1.0", "CC0 1.0 Universal license", "cc0"),
    ("EPL-2.0", "Eclipse Public License 2.0", "eclipse"),
    ("GPL-2.0", "GNU General Public License, version 2", "gnu"),
    ("GPL-3.0", "GNU General Public License, version 3", "gnu"),
    ("ISC", "ISC License", "isc"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1", "lesser"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3", "lesser"),
    ("MIT", "MIT License", "mit"),
    ("MPL-2.0", "Mozilla Public License, version 2.0", "mozilla"),
    ("Unlicense", "Unlicense", "unlicense"),
    ("Zlib", "zlib License", "zlib"),
)
#: How a licence is stated by its name or identifier.
FORMS = ("Licensed under the {name}.", "Released under the {name}.", "This work is licensed under the {name}.", "{name}")
SPDX = "SPDX-License-Identifier: {identifier}"

#: Sentences of public licence texts, notices and titles, as (identifier, sentence). A sentence may be in several licences.
SENTENCES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal license."),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)


def templates() -> tuple[tuple[str, str, str | None], ...]:
    """(licence, text, term that a statement has to hold, if any)."""
    out: list[tuple[str, str, str | None]] = [(licence, text, None) for licence, text in SENTENCES]
    for identifier, name, must in NAMES:
        out += [(identifier, form.format(name=name), must) for form in FORMS]
        own = identifier.lower().split("-")
        out.append((identifier, SPDX.format(identifier=identifier), "sa" if "sa" in own else "nc" if "nc" in own else own[0]))
    return tuple(out)
