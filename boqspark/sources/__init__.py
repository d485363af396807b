"""boqspark.sources"""
