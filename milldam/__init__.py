"""milldam: data-mining and analytics operators expressed as Spark DataFrame plans."""
