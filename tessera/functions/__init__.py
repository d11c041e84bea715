"""Values of the dialect: on the driver for constants, and as Spark columns."""
