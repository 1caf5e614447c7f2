"""Registered queries, one module per area."""


def all_registries():
    from registry import code, files, records, text

    return [code.R_, files.R_, text.R_, records.R_]
