"""The registered queries over the reference's own operators, with their SQL."""

from __future__ import annotations

from tessella.plans import assembly, bom, bom_lines, chunks, cleaning, columns, composition, imports, inference, items, learned, matching, ordering, pages, preview, products, quoting, recovered, takeoff, templates, texts, web

MODULES = (quoting, products, matching, ordering, texts, inference, cleaning, columns, items, imports, preview, composition, templates, bom, bom_lines, takeoff, learned, pages, chunks, assembly, web, recovered)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
