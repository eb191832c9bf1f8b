from checks import atlas, browse, climate, flavour, labs, library, reports, scores, spatial  # noqa: F401
