"""All queries of the library with their SQL, from every module that registers some."""

from quarry.plans import growth as growth
from quarry.plans import layouts as layouts
from quarry.plans import robust as robust
from quarry.plans import scans as scans
from quarry.plans import search as search
from quarry.plans.catalog import ORACLES as ORACLES
from quarry.plans.catalog import QUERIES as QUERIES
from quarry.plans.catalog import flagship as flagship
