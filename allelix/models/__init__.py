"""Mixed models, structure and prediction: Spark does the relational part, numpy small dense kernels."""
