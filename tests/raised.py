"""What a failing Spark job raises: PySpark does not always convert the error of the JVM."""

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

RAISED = (PySparkException, Py4JJavaError)
