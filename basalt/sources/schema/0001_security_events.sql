-- The store. Absence is the zero value; write_seq orders rows of one key.
CREATE TABLE IF NOT EXISTS security_events (
  event_id STRING,
  schema_version BIGINT,
  event_class STRING,
  event_time TIMESTAMP,
  observed_time TIMESTAMP,
  ingest_time TIMESTAMP,
  tenant_id STRING,
  agent_id STRING,
  host_hostname STRING,
  host_ip STRING,
  host_os STRING,
  host_architecture STRING,
  collector STRING,
  source STRING,
  sequence DECIMAL(20,0),
  gateway STRING,
  batch_id STRING,
  auth_activity STRING,
  auth_outcome STRING,
  auth_outcome_reason STRING,
  auth_method STRING,
  auth_user_name STRING,
  auth_user_domain STRING,
  auth_user_uid STRING,
  auth_service_name STRING,
  auth_service_protocol STRING,
  auth_source_ip STRING,
  auth_source_port INT,
  auth_destination_ip STRING,
  auth_destination_port INT,
  auth_transport STRING,
  auth_raw_record STRING,
  write_seq STRING,
  event_month INT
) USING parquet PARTITIONED BY (event_month)
