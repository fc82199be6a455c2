"""siftlode: a catalog quality engine expressed as Spark DataFrame plans."""
