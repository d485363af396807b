"""boqspark.functions"""
