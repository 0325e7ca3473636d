from erlink.plans import registry  # noqa: F401  # first: it loads the query modules, which register with it
