"""slotmill: byte-stream similarity and corpus preparation as Spark DataFrame plans."""
