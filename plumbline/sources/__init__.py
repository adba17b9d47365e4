"""Reading tables, describing catalogs and writing state tables."""
