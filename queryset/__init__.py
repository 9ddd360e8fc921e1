"""The registered queries: each operator of the library on the given tables, with the same result in SQL."""

from . import catalogs, files, profiles, prompting, sampling, search

MODULES = [profiles, sampling, search, catalogs, prompting, files]
