"""Analytics over document and annotation tables, expressed as Spark plans."""
